"""The numbered queries against brute-force versions over whole small tables."""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from html.parser import HTMLParser

import compare
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch
from tracewell.llm import best_fit, collocations, embeddings, extraction, language_model, mixing, neardup, packing, quality, queries, secrets, token_counts, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    compare.assert_same(queries.queries()[name](spark, sf_dir), compare.connect(sf_dir), queries.oracle_sql()[name])


def check_packing(rows, expected_ids):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(expected_ids)
    for doc, pieces in by_doc.items():
        ids, at = expected_ids[doc], 0
        for r in sorted(pieces, key=lambda r: r.start):
            own = ids[r.start : r.start + r.length]
            assert r.start == at and r.length == len(own) > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE and all(r.sequence_tokens == at for r in pieces)
    return len(by_sequence), sum(r.length for r in rows)


def test_packing(spark, sf_dir, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d.doc_id: [*whole.encode(d.text or "", add_special_tokens=False).ids, 1] for d in documents}
    sequences, tokens = check_packing(queries.op1_pack_sequences(spark, sf_dir).collect(), ids)
    assert sequences <= 1.02 * math.ceil(tokens / packing.SEQUENCE) + 1


def test_packing_ids_in_all_languages(spark):
    """The cut words give the ids that the tokenizer gives for whole texts: every document of the larger table."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    got: dict = defaultdict(dict)
    for r in packing.cut_documents(docs).collect():
        got[r.doc_id][r.start] = np.frombuffer(r.ids, dtype="<u4").tolist()
    found = [[i for start in sorted(pieces) for i in pieces[start]] for _, pieces in sorted(got.items())]
    assert found == [[*e.ids, 1] for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_packing_proves_its_gap_where_remainders_are_long():
    random = np.random.default_rng(3)
    found = packing.Patterns(np.arange(400, 1025), random.integers(50, 1000, 625))
    assert sum(n for _, n in found.patterns) <= (1 + packing.GAP) * found.bound + len(found.lengths) / 2


def test_packing_patterns_hold_their_demand():
    random = np.random.default_rng(1)
    lengths, demand = np.arange(1, 2049, 7), random.integers(1, 60, 293)
    found = packing.Patterns(lengths, demand)
    used = Counter()
    for pattern, times in found.patterns:
        assert sum(int(found.lengths[j]) * n for j, n in pattern.items()) <= 2048
        for j, n in pattern.items():
            used[int(found.lengths[j])] += n * times
    assert used == dict(zip(lengths.tolist(), demand.tolist(), strict=True))
    assert sum(times for _, times in found.patterns) <= 1.01 * math.ceil(lengths @ demand / 2048) + 1


def test_packing_proves_its_gap_over_all_lengths():
    """Remainders concentrated where greedy patterns are poor."""
    random = np.random.default_rng(1)
    lengths = np.arange(1, 2049)
    demand = random.integers(1, 20, 2048) + np.where((lengths >= 700) & (lengths <= 900), random.integers(500, 1500, 2048), 0)
    found = packing.Patterns(lengths, demand)
    assert sum(times for _, times in found.patterns) <= (1 + 2 * packing.GAP) * found.bound


def test_token_counts(spark, sf_dir, documents):
    model = token_counts.unigram()

    def best(text):
        scores = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            options = []
            for start in range(max(0, end - 50), end):
                piece = text[start:end]
                if piece in model.scores:
                    options.append((scores[start][0] + model.scores[piece], -scores[start][1] - 1))
            if text[end - 1] not in model.scores:
                options.append((scores[end - 1][0] + model.unknown, -scores[end - 1][1] - len(text[end - 1].encode())))
            total, n = max(options)
            scores.append((total, -n))
        return scores[-1]

    got = {r.doc_id: r for r in queries.op2_token_counts(spark, sf_dir).collect()}
    assert len(got) == len({d.doc_id for d in documents})
    for d in documents:
        if len(d.text or "") > 3000:
            continue
        score, n = best(" " + d.text) if d.text else (0.0, 0)
        assert got[d.doc_id].n_tokens == n
        assert got[d.doc_id].score == pytest.approx(score, rel=1e-9)


def test_language_model(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {d.doc_id: [*WORD.findall((d.text or "").translate(lower)), None] for d in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = Counter(t for i, x in tokens.items() if not held[i] for t in x)
    n, v = sum(counts.values()), len(counts)
    got = queries.op3_lm_score(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own), rel=1e-9)
        assert r.score < 0
    # held-out accuracy: the model beats the base score
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_language_model_is_a_distribution():
    """Classes sum to one, the parts of a class do, and so do the words of a part, in the model's own terms."""
    many = language_model.CLASSES // language_model.MEMBERS + language_model.MEMBERS + language_model.SUBS
    weights = np.random.default_rng(3).normal(size=(language_model.BUCKETS, many)).astype(np.float32)
    bounds, tokens = np.array([0, 20, 50]), np.arange(50, dtype=np.int32)
    row = {"bounds": bounds.tolist(), "ids": language_model.packed(tokens), "hashes": language_model.packed(np.arange(50, dtype=np.uint32))}

    def chances(classes, parts):
        own = row | {"classes": language_model.packed(np.full(50, classes, dtype=np.uint16)), "parts": language_model.packed(np.full(50, parts, dtype=np.uint8))}
        return np.exp(language_model.log_chances(language_model.split(weights), own, language_model.SINGLES))

    singles, room = language_model.SINGLES, range(language_model.SINGLES, language_model.CLASSES)
    total = sum(chances(c, 0) for c in range(singles)) + sum(chances(c, p) for c in room for p in range(language_model.SUBS))
    assert np.allclose(total, 1, atol=1e-4)
    mass = np.zeros((4 * 8, language_model.SUBS))
    mass[0, :2], mass[8 + 0, 3] = (2, 4), 34
    shares = language_model.Shares(100, 5, 2, 1, [(1, 60)], mass.reshape(-1).tolist())
    inner = 10 ** shares.inner(np.array([1, 1, 2, 2, 0]), np.full(5, singles), np.array([0, 0, 1, 1, 0]))
    assert inner[:2].sum() + inner[4] == pytest.approx(1) and inner[2:4].sum() == pytest.approx(1 - shares.unseen)


def test_language_model_scores_by_brute_force():
    """The score of each token from the weights, one after another: its group, its class in the group, its part."""
    random = np.random.default_rng(9)
    groups, members = language_model.CLASSES // language_model.MEMBERS, language_model.MEMBERS
    weights = random.normal(size=(1 << 10, groups + members + language_model.SUBS)).astype(np.float32)
    hashes, classes, parts = random.integers(1, 1 << 32, 30).astype(np.uint32), random.integers(0, language_model.CLASSES, 30).astype(np.uint16), random.integers(0, language_model.SUBS, 30).astype(np.uint8)
    parts[classes < language_model.SINGLES] = 0
    row = {"bounds": [0, 4, 30], "ids": language_model.packed(np.arange(30, dtype=np.int32)), "hashes": language_model.packed(hashes), "classes": language_model.packed(classes), "parts": language_model.packed(parts)}
    got = language_model.log_chances(language_model.split(weights), row, language_model.SINGLES)
    m = 1 << 64

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % m
        return x ^ (x >> 31)

    for t in range(30):
        start = 0 if t < 4 else 4
        one, two, three = (int(hashes[t - k]) if t - k >= start else (1 << 32) + k for k in (1, 2, 3))
        seeds = [one * 4 + 1, (mixed(one) + two) * 4 + 2, two * 4 + 3, mixed(three) * 4 + 3]
        at = [0, *(mixed(s % m) % 1023 + 1 for s in seeds)]

        def log_softmax(rows, columns, k):
            scores = weights[rows][:, columns].astype(float).sum(axis=0)
            return scores[k] - np.log(np.exp(scores - scores.max()).sum()) - scores.max()

        def within(outcome, kind):
            return [mixed((b * 0x9E3779B97F4A7C15 + outcome + 1 + (kind << 32)) % m) % 1024 for b in at]  # noqa: B023

        group, member = divmod(int(classes[t]), members)
        expected = log_softmax(at, slice(0, groups), group) + log_softmax(within(group, 1), slice(groups, groups + members), member)
        if classes[t] >= language_model.SINGLES:
            expected += log_softmax(within(int(classes[t]), 0), slice(groups + members, None), parts[t])
        assert got[t] == pytest.approx(expected, abs=1e-4)


def test_language_model_reruns_agree(spark, sf_dir):
    """Equal rows whatever the number of shuffle partitions, and equal texts have equal scores wherever they stand."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    twice = docs.unionByName(docs.selectExpr("doc_id + 1000000 as doc_id", "text"))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("3", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append({r.doc_id: (r.score, r.base_score) for r in language_model.score(twice, Scratch(spark, "t")).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    assert all(found[0][i] == found[0][i + 1000000] for i in found[0] if i < 1000000)


def test_language_model_weights_that_were_sent():
    """Weights from another process have numpy's own type again: with an equal one ufunc.at takes 30 times as long."""
    sent = pickle.loads(pickle.dumps(np.zeros((4, 40), dtype=np.float32)))
    assert all(t.dtype is np.dtype(np.float32) for t in language_model.split(sent))


def test_language_model_draws():
    """Outcomes are drawn by their probabilities, whatever their number."""
    for many in (3, 8, 16, 20):
        powers = np.exp(np.random.default_rng(many).normal(size=(6, many))).astype(np.float32)
        at = np.repeat(np.arange(1, 6)[:, None], 40000, axis=1)
        drawn = np.bincount(language_model.draw(powers, at, np.random.default_rng(1)), minlength=many)
        chance = powers[1:].astype(float).prod(axis=0)
        assert len(drawn) == many and np.allclose(drawn / 40000, chance / chance.sum(), atol=0.01)


def test_language_model_grows_with_the_corpus():
    """More training tokens give more buckets, singles and bins; bins part the tokens of any corpus; contexts are told apart by 32 bits."""
    small, large = language_model.Sizes(10**5), language_model.Sizes(10**11)
    assert (small.singles, language_model.ENDINGS, language_model.CLASSES) == (32, 8, 64)
    assert large.buckets > 16 * small.buckets and large.singles > small.singles and large.bins > small.bins
    mass = np.zeros(language_model.LEVELS)
    mass[[0, 10, 14, 18, 22]] = 5
    assert small.limits(mass) == (1, 2**15 - 1, 2**19 - 1)
    with np.errstate(over="ignore"):
        at = language_model.features(np.array([7, 1, 7 + (1 << 16), 1], dtype=np.uint32), np.array([0, 2, 4]), 1 << 20)
    assert at[1, 1] != at[1, 3]


def statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    inside = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def reached(values, share):
    ordered = np.sort(values)
    return ordered[int(np.ceil(share * len(ordered) - 1e-9)) - 1]


def squared(rows, centre, scatter):
    off = rows - centre
    return np.einsum("ni,ij,nj->n", off, np.linalg.inv(scatter), off)


def mcd(rows):
    """Reweighted minimum-covariance-determinant estimate of one group by numpy: its rows in reach, centre and covariance."""
    d, floors = rows.shape[1], quality.UNIT * np.array(list(quality.FLOOR.values()))
    floor = np.diag(floors**2)
    median = np.array([float(reached(rows[:, i], 0.5)) for i in range(d)])
    width = np.sqrt(np.array([1.4826 * reached(np.abs(rows[:, i] - median[i]), 0.5) for i in range(d)]) ** 2 + floors**2)
    z = (rows - median) / width
    starts = [(median, np.diag(width**2))]
    for shape in (np.tanh(z), z / np.sqrt((z * z).sum(axis=1) + 1e-12)[:, None]):
        cov = np.cov(np.round(1000 * shape).T, bias=True).reshape(d, d) + np.eye(d) * 100.0**2
        starts.append((median, cov * np.outer(width, width) / 1e6))

    def step(centre, scatter):
        bins = np.floor(np.log2(squared(rows, centre, scatter) + 2.0**-10) * 16)
        near = rows[bins <= reached(bins, quality.KEPT_SHARE)]
        scatter = np.cov(near.T, bias=True).reshape(d, d) + floor
        return np.linalg.slogdet(scatter)[1], near.mean(axis=0), scatter

    best = min((step(*step(*s)[1:]) for s in starts), key=lambda e: e[0])
    while (later := step(*best[1:]))[0] < best[0] - quality.FALL:
        best = later
    edge = quality.consistency(quality.KEPT_SHARE, d) * quality.chi_squared_quantile(quality.REWEIGHT_TAIL, d)
    near = rows[squared(rows, *best[1:]) <= edge]
    factor = quality.consistency(1 - quality.REWEIGHT_TAIL, d)
    return (len(near), near.mean(axis=0), factor * (np.cov(near.T, bias=True).reshape(d, d) + floor)) if len(near) else (0, np.zeros(d), np.zeros((d, d)))


def drawn(own, wider):
    weight = own[0] / (own[0] + quality.PRIOR)
    return own[0], weight * own[1] + (1 - weight) * wider[1], weight * own[2] + (1 - weight) * wider[2]


def test_chi_squared():
    assert quality.chi_squared_quantile(0.05, 6) == pytest.approx(12.5916, abs=1e-3)
    assert quality.chi_squared_quantile(0.25, 6) == pytest.approx(7.8408, abs=1e-3)
    sample = np.random.default_rng(2).normal(size=(200_000, 6))
    near = sample[(sample**2).sum(axis=1) <= quality.chi_squared_quantile(0.25, 6)]
    assert quality.consistency(0.75, 6) * near.var(axis=0).mean() == pytest.approx(1, abs=0.01)


def test_quality_rules(spark, documents, sf_dir):
    got = queries.op4_quality_rules(spark, sf_dir).collect()
    texts = {d.doc_id: d for d in documents}
    assert len(got) == len(documents)
    for r in got:
        expected = statistics(texts[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.distance <= quality.chi_squared_quantile(quality.TAIL, 6))


def test_quality_distances(spark):
    """Distances of all rows by numpy, over three languages and sources of very different sizes, nulls among them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    group = quality.F.pmod(quality.F.xxhash64("doc_id"), quality.F.lit(20))
    docs = docs.withColumn("lang", quality.F.when(group < 12, "en").when(group < 18, "de")).withColumn("source", quality.F.when(group % 7 > 0, "s1").when(group > 6, "s2"))
    scratch = Scratch(spark, "test")
    measured = scratch.save(quality.with_statistics(docs).drop("text"), "measured")
    names = list(quality._vector())
    passed = measured.where(~quality.base_failed())
    rows = passed.select("doc_id", "lang", "source", *[quality.F.round(quality.UNIT * v).cast("long").alias(k) for k, v in quality._vector().items()]).toPandas()
    whole = mcd(rows[names].to_numpy())
    expected = {}
    for _, of_lang in rows.groupby("lang", dropna=False):
        lang = drawn(mcd(of_lang[names].to_numpy()), whole)
        for _, own in of_lang.groupby("source", dropna=False):
            _, centre, scatter = drawn(mcd(own[names].to_numpy()), lang)
            expected |= dict(zip(own["doc_id"], squared(own[names].to_numpy(), centre, scatter), strict=True))
    assert len(rows.groupby(["lang", "source"], dropna=False)) >= 6
    got = {r.doc_id: r.distance for r in quality.judge(measured, scratch).where("distance is not null").collect()}
    assert got.keys() == expected.keys()
    close = np.array([abs(got[k] - v) <= 0.02 * v + 0.01 for k, v in expected.items()])
    assert close.all(), (1 - close.mean(), [(got[k], v) for (k, v), c in zip(expected.items(), close) if not c][:5])


def test_quality_rules_find_outliers_in_small_groups(spark):
    """Ten ordinary documents and one of symbols, a source of their own, beside a large source of the same language."""
    random = np.random.default_rng(4)
    vocabulary = ["".join(random.choice(list("abcdefghijklmnop"), random.integers(3, 9))) for _ in range(3000)]
    text = lambda: " ".join(random.choice(vocabulary, 150)).capitalize() + "."
    rows = [(k, text(), "en", "large") for k in range(400)] + [(1000 + k, text(), "en", "small") for k in range(10)]
    rows.append((2000, " ".join(w + "$#|" for w in random.choice(vocabulary, 150)), "en", "small"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep_good(docs, Scratch(spark, "t")).select("doc_id").collect()}
    assert kept == {r[0] for r in rows} - {2000}


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (Counter([tuple(words)]) if words else Counter())


def alike(one, other):
    common = (one & other).total()
    return common >= 0.8 * (one.total() + other.total() - common)


def test_minhash_dedup(spark, sf_dir, documents):
    sets = {d.doc_id: shingle_counts(d.text) for d in documents}
    ids = sorted(sets)
    pairs = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((sets[a].total(), sets[b].total()))
            if small and small >= 0.8 * large and alike(sets[a], sets[b]):
                pairs.append((a, b))
    assert pairs
    got = queries.op5_minhash_dedup(spark, sf_dir).collect()
    assert {r.doc_id: r.class_id for r in got} == classes(pairs, ids)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got) and len(got) == len(documents)


def edited(random, words, edits):
    words = list(words)
    for at in random.integers(0, len(words), edits):
        words[at] = f"e{random.integers(1 << 40)}"
    return words


def test_minhash_dedup_of_large_groups_of_near_copies(spark):
    """2,000 edited copies of one text, with repeated passages, a chain of versions, and texts that share half: all links."""
    random = np.random.default_rng(21)
    base = [f"w{k}" for k in random.integers(0, 400, 120)]
    base += base[:40]
    texts = [edited(random, base, int(random.integers(0, 12))) for _ in range(2000)]
    version = [f"v{k}" for k in range(150)]
    for _ in range(60):
        texts.append(version := edited(random, version, 2))
    passage = [f"p{k}" for k in range(60)]
    texts += [passage + [f"q{random.integers(1 << 40)}" for _ in range(50)] for _ in range(300)]
    counts = [shingle_counts(" ".join(t)) for t in texts]
    names = {s: k for k, s in enumerate({(s, n) for c in counts for s, m in c.items() for n in range(m)})}
    sizes = np.array([c.total() for c in counts])
    held = np.zeros((len(texts), len(names)), dtype=np.float32)
    for k, c in enumerate(counts):
        held[k, [names[s, n] for s, m in c.items() for n in range(m)]] = 1
    common = held @ held.T
    linked = np.triu(common >= 0.8 * (sizes[:, None] + sizes[None, :] - common) - 1e-3, 1)
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(rows, Scratch(spark, "t")).collect()}
    expected = classes(zip(*(x.tolist() for x in linked.nonzero()), strict=True), range(len(texts)))
    assert len(set(expected.values())) > 300 and got == expected


def test_weighted_darts_estimate_similarity():
    """Equal coordinates estimate the weighted Jaccard similarity: sum of least weights over sum of greatest."""
    random = np.random.default_rng(5)
    elements = random.integers(1, 1 << 62, 200).astype(np.uint64)
    a, b = random.uniform(0.1, 6, 200), random.uniform(0.1, 6, 200)
    with np.errstate(over="ignore"):
        signature = neardup.signatures(np.concatenate([elements, elements]), np.array([0, 200, 400]), np.concatenate([a, b]), k=2048)
    assert (signature[0] == signature[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_secret_scan(spark, sf_dir, documents):
    kinds = {
        "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile(r"AKIA[A-Z0-9]+"),
        "hex": re.compile(r"[0-9a-f]+"),
    }
    keep = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    texts = {d.doc_id: d.text or "" for d in documents}
    for r in queries.op7_secret_scan(spark, sf_dir).collect():
        spans = [(m.start(), k, m.end()) for k, p in kinds.items() for m in p.finditer(texts[r.doc_id]) if keep[k](m)]
        spans.sort(key=lambda s: (s[0], list(kinds).index(s[1])))
        written = [f"{k}:{a}:{b}" for a, k, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        count = Counter(k for _, k, _ in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (count["assign"], count["access"], count["hex"])
        assert set(written) <= set(r.spans.split(","))


def test_secret_model_tells_random_from_ordinary(spark):
    """Held-out accuracy on samples that the rule did not make."""
    model = secrets.train(secrets.generated_samples(spark))
    random = np.random.default_rng(11)
    alphabet = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    keys = ["".join(random.choice(alphabet, 40)) for _ in range(200)]
    names = random.choice(np.array(secrets.IDENTIFIER_WORDS), (200, 5))
    plain = ["_".join(x) for x in names] + ["".join(w.title() for w in x) for x in names]
    rows = spark.createDataFrame([(k, True) for k in keys] + [(p, False) for p in plain], "text string, secret boolean")
    judged = rows.select("secret", (secrets.log_ratio(rows["text"], model) > secrets.MIN_RATIO * quality.F.length("text")).alias("said")).collect()
    assert sum(r.said for r in judged if r.secret) >= 0.95 * len(keys)
    assert sum(r.said for r in judged if not r.secret) <= 0.01 * len(plain)


def test_embedding_dedup(spark, tmp_path):
    """All vectors of the table and, for recall near the threshold, turned copies of them with a cosine of 0.9 to 0.99."""
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    random = np.random.default_rng(8)
    planted = []
    for r in [r for r in given if r.embedding is not None and len(r.embedding) == 64 and np.isfinite(np.array(r.embedding, dtype=float)).all()][:200]:
        x = np.array(r.embedding, dtype=float)
        off = random.normal(size=64)
        off -= off @ x / (x @ x) * x
        cosine = random.uniform(0.9, 0.99)
        turned = cosine * x / np.linalg.norm(x) + (1 - cosine**2) ** 0.5 * off / np.linalg.norm(off)
        planted.append((1_000_000 + r.vec_id, turned.astype(np.float32).tolist(), 0))
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    table.unionByName(spark.createDataFrame(planted, table.schema)).write.parquet(f"{tmp_path}/embeddings.parquet")
    sf_dir = str(tmp_path)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    good = [r for r in rows if r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    x = np.array([r.embedding for r in good], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r for r in queries.op8_embedding_dedup(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    found = sum(got[r.vec_id].n_links for r in good)
    assert all(got[r.vec_id].n_links <= n for r, n in zip(good, linked.sum(axis=1), strict=True))
    assert found >= 0.9 * linked.sum() > 0
    expected = classes([(good[i].vec_id, good[j].vec_id) for i, j in zip(*linked.nonzero(), strict=True)], [r.vec_id for r in rows])
    assert np.mean([got[i].component_id == c for i, c in expected.items()]) >= 0.9


def test_embedding_dedup_of_buckets_over_one_block(spark):
    """3,000 vectors around one, none equal: buckets of several blocks, a link for nearly every pair, and recall by cosine."""
    random = np.random.default_rng(14)
    centre = random.normal(size=64)
    x = np.concatenate([centre + random.normal(size=(3000, 64)) * random.uniform(0.05, 0.42, (3000, 1)), random.normal(size=(200, 64))]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, 0)
    got = {r.vec_id: r for r in embeddings.near_duplicates(table, Scratch(spark, "t")).collect()}
    found, expected = np.array([got[i].n_links for i in range(len(x))]), (cosine >= 0.9).sum(axis=1)
    assert (found <= expected).all() and found.sum() >= 0.9 * expected.sum() > 0
    linked = {(i, j) for i, j in zip(*np.triu(cosine >= 0.9).nonzero(), strict=True)}
    component = classes([(int(i), int(j)) for i, j in linked], range(len(x)))
    assert np.mean([got[i].component_id == c for i, c in component.items()]) >= 0.9


def test_mixing_meets_targets(spark, sf_dir):
    rows = queries.op9_mix_sources(spark, sf_dir).toPandas()
    assert (rows["taken"] <= 2 * rows["size"]).all()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").toPandas()
    per = rows.merge(docs, on="doc_id").groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((per["taken"] - per["target"]).abs() <= per["most"] / 2 + 1).all()
    assert per["target"].sum() == pytest.approx(mixing.SHARE * rows["size"].sum())


def test_mixing_by_plain_python(spark):
    """Water-fill and selection written out, over documents of very unequal sizes and a source that is held."""
    random = np.random.default_rng(12)
    rows = [(k, "w " * int(2 ** random.uniform(0, 9)), source) for k, source in enumerate(random.choice(["a", "b", "c", "d", None], 900, p=[0.02, 0.4, 0.3, 0.2, 0.08]))]
    rows += [(k, t, s) for k, t, s in rows[:30]] + [(5000, None, "b"), (5001, "", "e")]
    docs = [(k, t, s, len((t or "").split())) for k, t, s in rows]
    sources = sorted({s for *_, s, _ in docs}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for *_, of, n in docs if of == s) for s in sources}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    targets, free, left = {}, set(sources), 1.5 * sum(sizes.values())
    while over := {s for s in free if left * weights[s] / sum(weights[x] for x in free) >= 2 * sizes[s]}:
        for s in over:
            targets[s] = 2.0 * sizes[s]
        left, free = left - sum(targets[s] for s in over), free - over
    targets |= {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
    expected, goal = defaultdict(list), {}
    for s in sources:
        mine = [(k, t, n) for k, t, of, n in docs if of == s]
        whole = int(targets[s] // sizes[s]) if sizes[s] else 0
        missing = targets[s] - whole * sizes[s]
        ranked = []
        for at, (k, t, n) in enumerate(mine):
            u = (int(hashlib.md5(":".join(["7", str(k), *([] if t is None else [t])]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            tilt = min(2.0, max(0.5, n * len(mine) / sizes[s])) if sizes[s] else 1.0
            ranked.append((u / (1 - u) / tilt, at))
        total, taken = 0, set()
        for _, at in sorted(ranked) if missing > 0 else []:
            if total + mine[at][2] > missing:
                break
            total, taken = total + mine[at][2], taken | {at}
        rest = [(abs(missing - total - mine[at][2]), q, at) for q, at in ranked if at not in taken and abs(missing - total - mine[at][2]) < missing - total]
        taken |= {min(rest)[2]} if rest else set()
        for at, (k, _, n) in enumerate(mine):
            expected[k].append(n * (whole + (at in taken)))
            goal[k] = targets[s]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    scratch = Scratch(spark, "t")
    got = mixing.mix(mixing.with_size_and_rank(table), scratch).collect()
    assert len(got) == len(rows)
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append(r.taken)
        assert r.target == pytest.approx(goal[r.doc_id])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    # longer documents come in more often, and none is shut out
    extra = [(r.mix_size, r.copies - int(r.target // r.source_size)) for r in got if r.source in ("b", "c")]
    long, short = ([c for n, c in extra if (n > 100) == side] for side in (True, False))
    assert 0 < np.mean(short) < np.mean(long) <= 1


def test_mixing_numbers_equal_rows(spark, tmp_path):
    """Sources of equal rows come within half a document of their targets, and the SQL agrees row by row."""
    rows = [(1, "w " * 20, "b")] * 100 + [(2, "x " * 30, "a")] * 7 + [(None, "y " * 9, None)] * 50 + [(None, None, None)] * 3 + [(k, "z " * (k % 40), "c") for k in range(3, 90)] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("extra", F.monotonically_increasing_id())
    table.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_mix_sources(spark, str(tmp_path))
    compare.assert_same(got, compare.connect(str(tmp_path)), mixing.ORACLE)
    sizes = {"b": 20, "a": 30, None: 9}
    per = mixing.mix(mixing.with_size_and_rank(table), Scratch(spark, "t")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.countDistinct("extra").alias("n"), F.max("copies").alias("most"))
    per = {r.source: r for r in per.collect()}
    assert {s: r.n for s, r in per.items()} == {"b": 100, "a": 7, None: 53, "c": 174} and max(r.most for r in per.values()) <= 2
    assert all(abs(per[s].taken - per[s].target) <= size / 2 for s, size in sizes.items())


class Lines(HTMLParser):
    """(text, length outside links, stretch) of each block, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.lines, self.parts, self.linked, self.stretch, self.dropped, self.links, self.articles = [], [], 0, 0, [], 0, 0
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if text := " ".join("".join(self.parts).split()):
            self.lines.append((text, max(0, len(text) - self.linked), self.stretch, self.articles))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attributes):
        if tag in extraction.BLOCKS:
            self.flush()
        self.stretch += tag in ("article", "main")
        self.articles += tag == "article"
        self.links += tag == "a"
        words = set((dict(attributes).get("class") or "").split())
        if tag == "br":
            self.parts.append(" ")
        elif self.dropped and tag == self.dropped[0]:
            self.dropped.append(tag)
        elif not self.dropped and tag not in extraction.VOID and (tag in ("nav", "footer", "aside", "form", "header", "script", "style", "title", "noscript", "button") or words & extraction.MARKS):
            self.dropped = [tag]

    def handle_endtag(self, tag):
        if tag in extraction.BLOCKS:
            self.flush()
        self.stretch += tag in ("article", "main")
        self.articles -= tag == "article"
        self.links -= tag == "a"
        if self.dropped and tag == self.dropped[0]:
            self.dropped.pop()

    def handle_data(self, data):
        if not self.dropped:
            self.parts.append(data)
            self.linked += len(data.strip()) if self.links else 0


def main_lines(lines):
    """Surge and dive, line by line."""
    block = {i: sum(n for _, n, s, _ in lines[i : i + 3] if s == lines[i][2]) for i in range(len(lines))}
    top = max(block.values(), default=0)
    keep = []
    for stretch in sorted({s for _, _, s, _ in lines}):
        mine = [i for i, (_, _, s, _) in enumerate(lines) if s == stretch]
        level = 0 if lines[mine[0]][3] else min(80, top / 2) if max(block[i] for i in mine) == top else max(80, top / 4)
        surges = [i for i in mine if lines[i][1] and block[i] >= level]
        if surges:
            first, last = surges[0], surges[-1]
            while first > mine[0] and lines[first - 1][1]:
                first -= 1
            while last + 1 <= mine[-1] and block[last + 1]:
                last += 1
            keep += lines[first : last + 1]
    return "\n".join(t for t, *_ in keep) if top else "\n".join(t for t, *_ in lines)


def test_html_extraction(spark):
    """Every page, and every page without article elements, against the same method over another parser."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()
    got = {r.page_id: r for r in queries.op6_html_extract(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for r in pages:
        assert got[r.page_id].text == main_lines(Lines(r.html or "").lines) and got[r.page_id].n_chars == len(got[r.page_id].text)
    same = [extraction.main_text(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", r.html or "")) == got[r.page_id].text for r in pages]
    assert np.mean(same) >= 0.95


def collocations_by_hand(rows, least, longest, overlap, top):
    """Every phrase counted in a dictionary, every cut and cover looked up: the definition, one language after another."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for n in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = set()
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in chosen.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(100 * b >= overlap * a and inside(q) for q, b in chosen.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out |= {(lang, rank, p.decode(), -a, left, right, total[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)}
    return out


@pytest.mark.parametrize(("least", "longest", "overlap", "top"), [(10, 3, 50, 2000), (2, 4, 80, 7), (3, 2, 50, 50)])
def test_collocations(spark, least, longest, overlap, top):
    random = np.random.default_rng(5)
    words = ["a", "b", "B", "ab", "été", "É", "x y", "😀", "c.", "d,", "(e)", "\x1f", "a\tb", "c\nd", "e\x0bf", "longer", "word"]
    rows = [(["en", "de", None, "und"][i % 4], " ".join(random.choice(words, int(random.integers(0, 40))))) for i in range(120)]
    rows += [("en", None), ("en", ""), ("fr", "one two three. " * 30), ("fr", "one two " * 2000), ("es", "x" * 100_000 + " y"), (None, ",;")]
    docs = spark.createDataFrame([(*r, "mine", 1) for r in rows], "lang string, text string, phrase string, f int").repartition(5)
    found = collocations.collocations(docs, Scratch(spark, "t"), least, longest, overlap, top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in found.collect()} == collocations_by_hand(rows, least, longest, overlap, top)


def test_collocations_several_automata_and_large_numbers(spark, monkeypatch):
    """Few phrases to an automaton, a full sketch and small blocks change nothing; products pass 64 bits."""
    rows = [("en", "alpha beta gamma. beta gamma alpha, " * 9), ("en", "alpha beta")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string")
    pieces = collocations.Pieces(pa.array([t for _, t in rows]), "en")
    phrases = ["alpha beta", "beta gamma", "gamma alpha", "alpha beta gamma", "beta gamma alpha", "gamma beta"]
    assert collocations.scan(pieces, phrases, 2).tolist() == collocations.scan(pieces, phrases).tolist() == [30, 54, 27, 27, 27, 0]
    expected = collocations_by_hand(rows, 10, 3, 50, 2000)
    monkeypatch.setattr(collocations, "LEAST_BITS", 9)  # most counters are shared
    monkeypatch.setattr(collocations, "MOST_BITS", 9)
    assert {tuple(r) for r in collocations.collocations(docs, Scratch(spark, "t")).collect()} == expected
    huge = spark.sql("select cast(1000000 as decimal(7,0)) * cast(9000000000000 as decimal(15,0)) * cast(9000000000000 as decimal(15,0)) div (cast(9000000000001 as decimal(19,0)) * cast(9000000000000 as decimal(18,0))) as s")
    assert int(huge.first().s) == 1_000_000 * 9_000_000_000_000**2 // (9_000_000_000_001 * 9_000_000_000_000)


def whole_vectors(rows):
    """x of each row that remains, as Python integers."""
    out = []
    for vec_id, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            out.append((vec_id, [min(max(math.floor(Fraction(float(c)) * 64), -(2**63)), 2**63 - 1 - 1_000_000) + 1_000_000 for c in v]))
    return out


def check_whitening(found, rows, components=16):
    """Every column against whole-number arithmetic over all rows; whitened against eigenpairs that solve the exact matrix."""
    x = whole_vectors(rows)
    fit = sorted({tuple(v) for _, v in x})
    n, d = len(fit), len(fit[0])
    sums = [sum(column) for column in zip(*fit, strict=True)]
    y = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for v in fit], dtype=object)
    exact = y.T.dot(y)
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in exact])
    values, vectors = np.linalg.eigh(v)
    many = min(components, d)
    values, vectors = values[::-1][:many], vectors[:, ::-1][:, :many]
    assert len(found) == many * len(x) and {r.n for r in found} == {n}
    by_row = defaultdict(list)
    for r in found:
        by_row[r.vec_id].append(r)
    signs = np.zeros(many)
    for vec_id, own in x:
        centred = [n * a - s for a, s in zip(own, sums, strict=True)]
        assert {int(r.deviation) for r in by_row[vec_id]} == {sum(c * c for c in centred)}
        mine = {r.component: r.whitened for r in by_row[vec_id]}
        assert set(mine) == set(range(1, many + 1))
        expected = (np.array([c / n for c in centred]) @ vectors) / np.sqrt(values)
        got = np.array([mine[k + 1] for k in range(many)])
        signs = np.where(signs == 0, np.where(np.abs(expected) > 1e-3, np.sign(got * expected), 0), signs)
        np.testing.assert_allclose(got, expected * np.where(signs == 0, 1, signs), rtol=1e-7, atol=1e-7)
    for r in found:
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-9) and r.identity_error <= 1e-9
    assert len({r.identity_error for r in found}) == 1


def test_whitening(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitening(queries.op11_whiten_embeddings(spark, sf_dir).collect(), rows)


def test_whitening_of_odd_vectors(spark):
    """Entries of very different sizes, repeated rows, rows to drop, fewer entries than components; deviations beyond long."""
    random = np.random.default_rng(3)
    made = (random.normal(size=(400, 6)) * [0.5, 1, 10, 1e3, 2, 3] + [0, 1e6, -1e7, 0, 5, 1]).tolist()
    rows = [(i, v) for i, v in enumerate(made)] + [(1000 + i, made[7]) for i in range(50)]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, component int").repartition(7)
    found = whitening.whiten(table, Scratch(spark, "t")).collect()
    check_whitening(found, rows)
    assert max(int(r.deviation) for r in found) > 2**40


def test_limb_products_are_exact():
    random = np.random.default_rng(4)
    for most in (1, 1 << 19, 1 << 20, 1 << 39, 1 << 61):
        y = random.integers(-most, most + 1, size=(300, 5))
        whole = whitening.Gram(5)
        for a in range(0, 300, 64):
            whole.add(y[a : a + 64])
        assert (whole.close() == y.astype(object).T.dot(y.astype(object))).all()
    huge = random.integers(-(1 << 61), 1 << 61, size=(50, 3)).astype(object) * 10**30
    whole = whitening.Gram(3)
    whole.add(huge)
    assert (whole.close() == huge.T.dot(huge)).all()


def test_eigenvectors_to_extended_precision():
    random = np.random.default_rng(6)
    q, _ = np.linalg.qr(random.normal(size=(12, 12)))
    a = (q * 10.0 ** np.linspace(0, -6, 12)) @ q.T
    a = ((a + a.T) / 2).astype(np.longdouble)
    values, x = whitening.eigenvectors(a)
    assert np.abs(a @ x - x * values).max() < 1e-17 and np.abs(x.T @ x - np.eye(12)).max() < 1e-17
    values, x = whitening.eigenvectors(np.eye(4, dtype=np.longdouble))  # none can be told apart
    assert np.allclose(values.astype(float), 1) and np.allclose((x.T @ x).astype(float), np.eye(4))


def test_best_fit_packing(spark, sf_dir, documents):
    """Every id in its place, nothing cut that fits, sequences gapless; as few sequences as the bound but for a few."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = queries.op13_best_fit_packing(spark, sf_dir).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {d.doc_id for d in documents}
    for d in documents:
        ids = whole.encode(d.text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [(k, a, min(2048, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 2048))]
        for r in pieces:
            own = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in pieces]).tolist()
        assert [r.offset for r in pieces] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert {r.all_sequences for r in rows} == {len(by_sequence)} and rows[0].least_sequences <= len(by_sequence) <= 1.02 * rows[0].least_sequences + 1


def best_fit_piece_by_piece(lengths, capacity, weights, rule):
    """One piece after another into one open sequence after another."""
    free = []
    for n in sorted(lengths, reverse=True):
        ask = (n, 1, n * n)
        fits = [s for s in free if all(a <= r for a, r in zip(ask, s, strict=True))]
        if rule == "norm":
            score = lambda s: sum(w * ((r - a) / c) ** 2 for w, r, a, c in zip(weights, s, ask, capacity, strict=True))  # noqa: B023, E731
        else:
            score = lambda s: sum(w * (a / c) * (r / c) for w, r, a, c in zip(weights, s, ask, capacity, strict=True))  # noqa: B023, E731
        if fits:
            best = min(fits, key=lambda s: (score(s), s))
            free.remove(best)
        else:
            best = capacity
        free.append(tuple(r - a for r, a in zip(best, ask, strict=True)))
    return free


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("tokens", "documents", "attention"), [(64, None, None), (64, 3, None), (64, None, 1500), (40, 5, 1600)])
def test_best_fit_by_counts(rule, tokens, documents, attention):
    """Bulk placement gives the sequences of piece after piece, and holds every capacity."""
    random = np.random.default_rng(tokens + (documents or 0))
    for _ in range(12):
        most = min(tokens, int((attention or tokens * tokens) ** 0.5))
        pieces = random.integers(1, most + 1, int(random.integers(1, 150)))
        lengths, demand = np.unique(pieces, return_counts=True)
        solved = best_fit.BestFit(lengths, demand, tokens, documents, attention, (1.0, 0.5, 2.0), rule)
        free = best_fit_piece_by_piece(pieces.tolist(), tuple(solved.capacity.tolist()), (1.0, 0.5, 2.0), rule)
        assert solved.sequences == len(free) >= best_fit.least_sequences(lengths, demand, tokens)
        held = defaultdict(list)
        ranks = defaultdict(list)
        runs = sorted(solved.runs)
        for (length, rank, sequence, each, offset), after in zip(runs, [*runs[1:], (0, 0, 0, 0, 0)], strict=True):
            upto = after[1] if after[0] == length else int(demand[lengths == length][0])
            ranks[length] += range(rank, upto)
            for k in range(upto - rank):
                held[sequence + k // each].append((offset + k % each * length, length))
        assert {n: len(r) for n, r in ranks.items()} == dict(zip(lengths.tolist(), demand.tolist(), strict=True))
        left = []
        for contents in held.values():
            contents.sort()
            assert [a for a, _ in contents] == [0, *np.cumsum([n for _, n in contents])[:-1].tolist()]
            left.append(tuple((solved.capacity - [sum(n for _, n in contents), len(contents), sum(n * n for _, n in contents)]).tolist()))
        assert sorted(left) == sorted(free) and min(map(min, left)) >= 0


def test_word_encoder():
    """Each fast path against the tokenizer: ends, letters beyond ASCII, special tokens' strings, white space of all kinds."""
    from tracewell.llm.tokenizing import WordEncoder

    encoder = WordEncoder("word_bpe_49k.json")
    texts = [
        "Don't I'LL we'VE 'tis it's it'Re 's's 's't''dd", "<|startoftext|>a<|endoftext|> <|STARTOFTEXT|> a<|b < a<b<< <<|", "a\x00b \x00 x\x1cy z\x85w a\xa0b \x0b\x0c \n",
        "É ÀÉ²a ¼x ŸŽſ ŉ İx ǅ Ⱥa \xad ªº µ ÷× Œœ ΑΣ ß ﬁ é", "😀😀 日本語 한국 naïve’s ‘x’", "a1b2 --==## ...!!! _x_", "", None, "x" * 5000 + " " + "ab" * 3000,
    ]
    for _ in range(2):  # the second time from memory
        ids, tokens = encoder.encode(pa.array(texts), 0)
        for text, own in zip(texts, np.split(ids, np.cumsum(tokens)[:-1]), strict=True):
            assert own.tolist() == encoder.whole.encode(text or "", add_special_tokens=False).ids + [0]
    assert [x.tolist() for x in encoder.encode(pa.array([], pa.string()), 0)] == [[], []]
