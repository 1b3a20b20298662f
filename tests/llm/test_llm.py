import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from foliomill.llm import ann, licenses, lm, mixing, neardup, packing, queries, repetition, sharding, substring, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid string, score string, position int"
RNG = random.Random(3)
LONG = " ".join(RNG.choice("uno due tre quattro cinque sei sette otto nove dieci".split()) + str(RNG.randrange(50)) for _ in range(30_000))


def odd_rows():
    texts = [None, "", "   \n", "word", "a b c d e f g h", LONG, LONG, LONG + " more", "é ü ß 日本語"]
    rows = [(i, t, "en", "s" if i % 2 else None, len(t or ""), "x", "y", 1) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[5], (None, "no id here", None, None, None, None, None, None), (4, "another text of the same id", "en", "s", 5, "x", "y", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 1), (4, 0, 0), (None, 1, 1), (5, 1, None), (5, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "substring": lambda d, l: substring.repeated_passages(d), "sharding": lambda d, l: sharding.shard_documents(d), "licenses": lambda d, l: licenses.license_scan(d), "packing": lambda d, l: packing.pack_documents(d),
    "lm": lambda d, l: lm.score_documents(d), "repetition": lambda d, l: repetition.repetition_rule(d), "mixing": lambda d, l: mixing.curriculum(d), "toxicity": toxicity.toxicity, "neardup": lambda d, l: neardup.near_duplicates(d),
}
EACH_ROW = ("sharding", "lm", "repetition", "toxicity")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, labels, name):
    found = OPERATORS[name](odd, labels).collect()
    if name in EACH_ROW:
        assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in odd_rows())
    if name == "neardup":
        assert {r["doc_id"]: r["group_id"] for r in found} == {5: 5, 6: 5, 7: 5} and sum(r["keep"] for r in found) == 1
    if name == "licenses":
        assert found == []
    if name == "packing":  # null, empty and blank texts have no piece; repeated rows are packed each for itself
        pieces = Counter((r["doc_id"], r["piece"]) for r in found)
        assert pieces[3, 0] == 1 and pieces[4, 0] == 3 and pieces[5, 0] == 2 and pieces[6, 0] == 1 and pieces[None, 0] == 1 and not any(pieces[i, 0] for i in (0, 1, 2))
        assert len({(r["bin_id"], r["bin_offset"]) for r in found}) == len(found) and sum(r["piece_tokens"] for r in found if r["doc_id"] == 6) == 30_000
    if name == "mixing":
        assert {r["doc_id"] for r in found} == {r[0] for r in odd_rows()} and [r["position"] for r in found] == sorted(r["position"] for r in found)
        assert all(r["n_tokens"] == 0 for r in found if r["doc_id"] in (0, 1, 2)) and sum(r["doc_id"] == 4 and r["epoch"] == 1 for r in found) == 3
    if name == "substring":
        assert {r["doc_id"] for r in found} == {5, 6, 7} and all(r["end_word"] >= 30_000 for r in found)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, labels, name):
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_stages_keep_columns_and_whole_rows(spark, odd, labels, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == odd.columns
    assert docs.where("doc_id IS NULL").count() >= 1
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "piece", "piece_start", "piece_tokens", "bin_id", "bin_offset"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    assert oracle.difference(spark, queries.queries()[name], queries.oracle_sql()[name]) == ""


def test_pipeline_stage_by_stage(spark):
    """Each stage on its predecessor's rows against a plain version of it."""
    d = oracle.DATA
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lab = spark.read.parquet(f"{d}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, lab).where("toxic").collect()}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["toxicity"](spark, docs, d)
    rows = {r["doc_id"]: r["text"] for r in one.collect()}
    assert set(rows) == {r["doc_id"] for r in docs.collect()} - toxic

    def shingle_set(t):
        w = t.lower().split()
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}

    sets, root = {i: shingle_set(t) for i, t in rows.items()}, {i: i for i in rows}
    for a, b in itertools.combinations(sorted(rows), 2):
        if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
            a, b = root[a], root[b]
            root = {i: min(a, b) if r in (a, b) else r for i, r in root.items()}
    kept = {r["doc_id"]: r["text"] for r in stages["near_duplicates"](spark, one, d).collect()}
    assert set(kept) == set(root.values())
    seen, want = set(), {}
    for i in sorted(kept):
        words, cut = kept[i].split(), set()
        for k in range(len(words) - substring.MIN_WORDS + 1):
            window = tuple(words[k : k + substring.MIN_WORDS])
            if window in seen:
                cut.update(range(k, k + substring.MIN_WORDS))
            seen.add(window)
        want[i] = [w for k, w in enumerate(words) if k not in cut]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    three = stages["substring_dedup"](spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in kept.items()], schema), d)
    assert {r["doc_id"]: r["text"].split() for r in three.collect()} == {i: w for i, w in want.items() if w}


def test_stages_leave_clashing_names_alone(spark, labels):
    names = ["_rid", "_score", "_spans", "_new", "row", "key", "spans", "rid", "new", "text2", "component", "_cut_id", "_key", "_last", "_block", "doc.id"]
    texts = ["same words " * 30, "same words " * 30, "some other text", None, "you are all idiots and trash, shut up"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for made in (toxicity.without_toxic(docs, labels), neardup.without_near_duplicates(docs), substring.without_repeats(docs), mixing.mixed_documents(docs)):
        assert made.columns == docs.columns
        for r in made.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names]


def test_hot_prefixes_give_the_same_spans(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet")
    rows = [Counter(map(tuple, substring.repeated_passages(docs, group_rows=n).collect())) for n in (1, substring.GROUP_ROWS)]
    assert rows[0] == rows[1] and rows[0]


def test_cutting_spans_keeps_the_rest_to_the_byte():
    texts = pa.array(["a  bé\tc d\n e ", None, "x y z", ""])
    spans = pa.array([[{"start": 1, "end": 3}], None, [{"start": 0, "end": 1}, {"start": 2, "end": 3}], None], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    assert substring.without_spans(texts, spans).to_pylist() == ["a  d\n e ", "", "y ", ""]
    assert substring.without_spans(texts.slice(2), spans.slice(2)).to_pylist() == ["y ", ""]


def test_sieve_loses_no_key(spark):
    from foliomill.llm import common

    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    for most in (1 << 25, 1 << 12):
        passes = common.sieve(keys, most)
        assert keys.where(passes(F.col("key"))).count() == 5000
    assert spark.range(5000, 55_000).where(common.sieve(keys)(F.xxhash64("id"))).count() < 2_500


def test_small_source_lasts_to_the_end(spark):
    docs = [(i, "w " * 1000, "big") for i in range(200)] + [(1000 + i, "w " * 9, "small") for i in range(2)]
    found = mixing.curriculum(spark.createDataFrame(docs, "doc_id long, text string, source string")).where("source = 'small'").agg(F.max("position"), F.max("epoch")).first()
    assert found[0] > 0.95 and found[1] > 4


def test_equal_rows_spread_over_buckets(spark):
    docs = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("one text of six words here").alias("text"))
    found = packing.pack_documents(docs, bucket_pieces=100)
    assert found.count() == 3000 and found.select(F.shiftright("bin_id", 32)).distinct().count() > 20


def test_groups_meet_their_runs_in_parts(spark):
    rng = random.Random(9)
    rows = [(f"g{i}", rng.choice([0, 5, 5, 5, 7, 30, 60])) for i in range(400)]
    frame = spark.createDataFrame(rows, "group_key string, group_size long")
    for width in (3, 100_000):
        found = sharding.pack_shards(frame, 50, width).collect()
        runs = sharding.best_fit_runs(list(Counter(s for _, s in rows).items()), 50)
        assert Counter((r["group_size"], r["shard_id"]) for r in found) == Counter((s, shard) for s, a, b, shard in runs for _ in range(b - a)) and len({r["group_key"] for r in found}) == 400
    assert sharding.pack_shards(frame.limit(0)).count() == 0


def test_sharding_of_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet")
    found = queries.op3_sharding(spark, oracle.DATA).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in docs.collect())
    size, shards = defaultdict(int), defaultdict(set)
    for r in docs.collect():
        size[r["text"] or ""] += len((r["text"] or "").encode())
    for r in found:
        shards[r["group_key"]].add(r["shard_id"])
    assert all(len(s) == 1 for s in shards.values()) and Counter(size.values()) == Counter(dict((r["group_key"], r["group_size"]) for r in found).values())
    plain: list[int] = []
    for s in sorted(size.values(), reverse=True):
        fits = [(room, i) for i, room in enumerate(plain) if room >= s]
        if fits and s <= sharding.CAPACITY:
            plain[min(fits)[1]] -= s
        else:
            plain.append(sharding.CAPACITY - s)
    assert len(plain) == len({r["shard_id"] for r in found})


def test_packing_query_is_whole(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect()
    found = queries.op5_packing(spark, oracle.DATA).collect()
    want = {r["doc_id"]: (r["text"].count(" ") + r["text"].count("\n") + 1 if (r["text"] or "").strip() else 0) for r in docs}
    by_doc, by_bin = defaultdict(int), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]] += r["piece_tokens"]
        assert r["piece_start"] == r["piece"] * packing.CAPACITY
        by_bin[r["bin_id"]].append((r["bin_offset"], r["piece_tokens"]))
    assert dict(by_doc) == {i: n for i, n in want.items() if n}
    for parts in by_bin.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert len(by_bin) <= 1.02 * sum(want.values()) / packing.CAPACITY + 2


def test_licences_that_share_their_clauses_are_told_apart():
    m = licenses.Matcher(licenses.TEMPLATES, licenses.THRESHOLD)
    names = lambda t: [x[0] for x in m.notices(t)]
    for name in ("BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "GPL-2.0-header", "GPL-3.0-header", "ISC"):
        assert names("prefix words " + licenses.TEMPLATES[name].upper()) == [name]
    assert names(licenses.TEMPLATES["Apache-2.0-header"] + " some words between " + licenses.TEMPLATES["Proprietary"]) == ["Apache-2.0-header", "Proprietary"]


def test_neighbours_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, distance string"
    assert ann.knn_join(spark.createDataFrame([], schema)).count() == 0
    equal = spark.createDataFrame([(i, [1.0, 2.0], "x") for i in range(5)] + [(9, None, None)], schema)
    got = {(r["vec_id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in ann.knn_join(equal, k=2).collect()}
    assert got[0, 1] == (1, 0.0) and got[4, 2] == (1, 0.0) and len(got) == 10


def test_sharding_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(20):
        sizes = [rng.randrange(0, 60) for _ in range(rng.randrange(1, 80))]
        room, plain = [], []
        for s in sorted(sizes, reverse=True):
            fits = [(r, i) for i, r in enumerate(room) if r >= s and s <= 50]
            if fits:
                r, i = min(fits)
                room[i] -= s
            else:
                i = len(room)
                room.append(50 - s if s <= 50 else -1)
            plain.append((s, i))
        runs = sharding.best_fit_runs(list(Counter(sizes).items()), 50)
        assert Counter((s, shard) for s, a, b, shard in runs for _ in range(b - a)) == Counter(plain)


def test_packing_is_whole_and_at_a_local_optimum():
    rng = random.Random(6)
    for _ in range(10):
        sizes = [rng.randrange(1, 40) for _ in range(60)]
        bins = packing.pack(sizes, 50)
        assert sorted(i for b in bins for i in b) == list(range(60)) and all(sum(sizes[i] for i in b) <= 50 for b in bins)
        assert len(bins) <= len(packing.best_fit(sizes, 50))
        under = [packing._Bin(b, sizes) for b in bins if sum(sizes[i] for i in b) < 50]
        assert all(packing._best_exchange(b, [x for x in under if x is not b], 50) is None for b in under if len(under) > 1)


def test_repetition_against_brute_force():
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    count, covered, longest = repetition.measure(pa.array(texts), 4)
    for t, n, c, m in zip(texts, count, covered, longest):
        w, inside, best = t.split(), set(), 0
        for i, j in itertools.combinations(range(len(w)), 2):
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            if k >= 4:
                best = max(best, k)
                inside |= set(range(i, i + k)) | set(range(j, j + k))
        assert (n, c, m) == (len(w), len(inside), best)


def test_language_model_gradients_and_state():
    rng = np.random.default_rng(0)
    p = {k: v if k == "edges" else v.astype(np.float64) for k, v in lm.fresh(1000 / (1 + np.arange(lm.VOCABULARY))).items()}
    ids = rng.integers(0, lm.VOCABULARY, 30).astype(np.int16)
    x, y = ids[:12].reshape(6, 2).astype(np.int64), ids[12:24].reshape(6, 2).astype(np.int64)
    starts, real = np.zeros((6, 2), bool), np.ones((6, 2), bool)
    starts[0] = starts[3, 1] = True
    h = np.zeros((lm.HIDDEN, 2))
    g, _, _ = lm.gradients(p, x, y, starts, real, h)
    dense = np.zeros_like(p["emb"])
    dense[g["emb"][0]] = g["emb"][1]
    g["emb"] = dense
    for name in lm.TRAINED:
        for at in ([tuple(int(rng.integers(n)) for n in p[name].shape) for _ in range(6)] + [(int(x[1, 0]), 3)] * (name == "emb") + [(int(y[2, 1]), n) for n in (0, lm.HIDDEN)] * (name == "ww")):
            loss = []
            for d in (1e-4, -1e-4):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += d
                loss.append(lm.gradients(q, x, y, starts, real, h)[2] / 12)
            assert abs((loss[0] - loss[1]) / 2e-4 - g[name][at]) < 1e-5
    count = np.array([7, 1, 22])
    together = lm.log_likelihoods(p, ids, count)
    for k, (a, b) in enumerate(((0, 7), (7, 8), (8, 30))):
        state, total = np.zeros(lm.HIDDEN), 0.0
        for t in range(a, b):
            inputs = p["b"] if t == a else p["emb"][ids[t - 1]] @ p["w"] + p["b"]
            z, r, n = np.split(inputs, 3)
            az, ar, an = np.split(state @ p["u"], 3)
            z, r = 1 / (1 + np.exp(-z - az)), 1 / (1 + np.exp(-r - ar))
            n = np.tanh(n + r * an)
            state = (1 - z) * n + z * state
            total += lm.log_probabilities(p, np.append(state, 1)[None], ids[t : t + 1].astype(np.int64))[0]
        assert abs(total - together[k]) < 1e-3


def test_output_probabilities_add_up():
    p = lm.fresh(1000 / (1 + np.arange(300)))
    h = np.tile(np.append(np.linspace(-1, 1, lm.HIDDEN), 1).astype(np.float32), (300, 1))
    assert abs(np.exp(lm.log_probabilities(p, h, np.arange(300))).sum() - 1) < 1e-4


def test_lanes_hold_every_token_once_and_long_texts_pad_nothing():
    rng = np.random.default_rng(4)
    count = np.array([1_000_000, *rng.integers(1, 300, 200)])
    ids = np.arange(count.sum()).astype(np.int32) % 5000
    laid, seen, cells = lm.Lanes(ids, count, 64), [], 0
    for x, y, starts, real, _ in laid.windows(20):
        seen.append(y[real])
        cells += y.size
        assert x.shape[0] <= lm.LONGEST_WINDOW and (x[1:][real[1:] & ~starts[1:]] == y[:-1][real[1:] & ~starts[1:]]).all()
    assert np.array_equal(np.sort(np.concatenate(seen)), np.sort(ids)) and cells < 1.05 * len(ids)


def test_corpus_sets_rounds_and_shards():
    assert lm.schedule(1_000) == (2, 1)
    (r1, s1), (r2, s2) = lm.schedule(10**9), lm.schedule(10**12)
    assert 2 < r1 < r2 and s1 < s2 and abs(r2 * s2 * 100 * lm.vocabulary_size(10**12) / 10**12 - 1) < 0.1 and lm.vocabulary_size(10**14) < 800_000


def test_vocabulary_does_not_depend_on_partitions(spark):
    docs = spark.range(400).select("id", F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(60) * (k + 1)).cast("string")) for k in range(60)]).alias("text"))
    found = [lm.vocabulary(docs.repartition(n)) for n in (1, 7)]
    assert np.array_equal(found[0][0], found[1][0]) and found[0][1] == found[1][1] == 24_000


def test_language_model_learns(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat " * 20) for i in range(200)] + [(900, "mat the on sat cat the " * 20)], "doc_id long, text string")
    found = {r["doc_id"]: r["perplexity"] for r in lm.score_documents(docs).collect()}
    assert found[0] < found[900]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(60, None, "c"), (61, [0.0] * 8, "c"), (62, [1.0], "c"), (None, [1.0] * 8, "c"), (63, [float("nan")] * 8, "c"), (0, x[0].tolist(), "c")]
    found = ann.knn_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string"), k=5, block_rows=16, stripe_rows=20).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    distance = np.round(1 - unit @ unit.T, 6)
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["vec_id"], r["rank"])):
        got[r["vec_id"]].append(r["neighbor_id"])
    assert dict(got) == {i: sorted((j for j in range(60) if j != i), key=lambda j: (distance[i, j], j))[:5] for i in range(60)}


def test_chosen_path_recall(spark):
    rng = random.Random(8)
    docs = []
    for i in range(300):
        words = [f"w{rng.randrange(100000)}" for _ in range(120)]
        docs.append((2 * i, " ".join(words)))
        for k in rng.sample(range(120), 8):
            words[k] = "changed"
        docs.append((2 * i + 1, " ".join(words)))
    found = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), leaf=16).collect()
    pairs = {r["doc_id"] // 2 for r in found}
    assert len(pairs) >= 0.97 * 300 and all(r["group_id"] == r["doc_id"] // 2 * 2 for r in found)


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"  # smaller tables hold a handful of held-out toxic rows
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = lab.where("pmod(xxhash64(doc_id, 7), 4) = 0").select("doc_id", F.col("toxic").alias("truth"))
    found = toxicity.toxicity(docs, lab.join(held, "doc_id", "left_anti")).join(held, "doc_id").groupBy("toxic", "truth").count().collect()
    n = {(r["toxic"], r["truth"]): r["count"] for r in found}
    assert n.get((True, 1), 0) >= 0.75 * (n.get((True, 1), 0) + n.get((False, 1), 0)) and n.get((True, 0), 0) <= 5


def test_language_model_grows_with_the_corpus(spark):
    docs = [(i, " ".join(f"w{(i * 7919 + k * k) % 20011}" for k in range(1000)), None) for i in range(2500)]
    few = spark.createDataFrame(docs[:1000], "doc_id long, text string, source string")
    many = spark.createDataFrame(docs, "doc_id long, text string, source string")
    small, large = lm.vocabulary(few)[0], lm.vocabulary(many)[0]
    assert len(small) + lm.FIRST_WORD == lm.VOCABULARY and len(large) + lm.FIRST_WORD == lm.vocabulary_size(2_500_000) > 3000
    assert len(lm.fresh(np.ones(lm.FIRST_WORD + len(large)))["emb"]) == lm.FIRST_WORD + len(large)


def test_word_counts_drop_nothing(spark):
    rare = [f"rare{i}" for i in range(50)]
    docs = spark.createDataFrame([(" ".join(["often"] * 70_000 + rare),), (" ".join(rare),), (None,)], "text string").coalesce(1)
    counts = sorted(r["n"] for r in lm.word_counts(docs).collect())
    assert counts == [2] * 50 + [70_000]


def test_other_words_are_scored_by_their_bytes(spark):
    rng = random.Random(11)
    frequent = [f"f{i}" for i in range(2100)]
    syllables = ["ba", "ne", "lo", "ti", "ru", "sha", "mo", "ki"]
    texts = [" ".join([*frequent, *frequent, *("".join(rng.choice(syllables) for _ in range(5)) for _ in range(200))]) for _ in range(8)]
    words = ["".join(rng.choice(syllables) for _ in range(6)) for _ in range(40)]
    noise = ["".join(rng.choice("qxzjvwkyQXZ0123456789") for _ in w) for w in words]
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(words), " ".join(noise)])), "doc_id long, text string")
    found = {r["doc_id"]: r["log_likelihood"] for r in lm.score_documents(docs).collect()}
    assert abs(found[8] - found[9]) > 1
    clean = docs.where("doc_id < 8")
    model, scores = lm.spelling_model(clean, lm.vocabulary(clean)[0]), []
    for text in (words, noise):
        w = lm.Words(pa.array([" ".join(text)]))
        scores.append(model.log_probabilities(w.raw, w.start, w.end))
    assert (scores[0] > scores[1]).all()


def test_spelling_is_a_distribution(spark):
    docs = spark.createDataFrame([("ab abc b é",), ("ab " + "x" * 40 + " " + "y" * 33,)], "text string")
    model = lm.spelling_model(docs, np.zeros(0, np.uint64))
    pairs = np.array([[a, b] for a in range(256) for b in range(256)], np.uint8).reshape(-1)
    at = np.arange(0, len(pairs), 2)
    assert abs(np.exp(model.log_probabilities(pairs, at, at + 2)).sum() - 1) < 1e-5
    for text in ("a", "ab", "abc", "zz"):
        raw, p = np.frombuffer(text.encode(), np.uint8), 1.0
        for i in range(len(raw)):
            p *= np.exp(model.log_probabilities(raw, np.array([0]), np.array([i + 1])) - (model.log_probabilities(raw, np.array([0]), np.array([i])) if i else 0))[0]
        assert abs(np.log(p) - model.log_probabilities(raw, np.array([0]), np.array([len(raw)]))[0]) < 1e-5
    assert abs(np.exp(model.last) + np.exp(model.more) - 1) < 1e-9
    raw = np.frombuffer("ab abc bcab éa zza".encode(), np.uint8)
    start = np.arange(len(raw) - 4)
    dense = model.log_probabilities(raw, start, start + 4)
    model.place = None
    assert np.abs(dense - model.log_probabilities(raw, start, start + 4)).max() < 1e-5
    assert len(lm.Spelling(np.zeros(0, np.int64), np.zeros(0, np.int64)).log_probabilities(raw, np.array([0]), np.array([2]))) == 1


def test_near_texts_are_joined_without_a_look_at_every_pair():
    """op10_neardup, pipeline (F3, F1): a set of k texts that are all alike cost the square of k in each of its nodes."""
    import time

    rng = np.random.Generator(np.random.PCG64(3))
    near = rng.integers(0, 2**63, (1, 4)).astype(np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (8000, 4)).astype(np.uint64))
    far = rng.integers(0, 2**63, (8, 4)).astype(np.uint64)
    began = time.process_time()
    roots = neardup.alike(np.concatenate([near, far]), 48)
    assert time.process_time() - began < 8 and len(set(roots[:8000])) == 1 and len(set(roots)) == 9
    for _ in range(40):
        texts = [np.unique(np.where(rng.random(20) < 0.3, rng.integers(100, 200, 20), np.arange(20) + 20 * rng.integers(0, 3))).astype(np.uint64) for _ in range(30)]
        link = {(i, j) for i in range(30) for j in range(30) if 2 * len(np.intersect1d(texts[i], texts[j])) >= len(np.union1d(texts[i], texts[j]))}
        want = list(range(30))
        for _ in range(30):
            want = [min(want[j] for j in range(30) if (i, j) in link) for i in range(30)]
        assert neardup.jaccard_sets(np.concatenate(texts), np.array([len(t) for t in texts]), 0.5).tolist() == want


def test_texts_that_share_a_passage_are_not_all_compared():
    """pipeline, op10_neardup (F1): texts that share a passage, but too little to be near, were each compared with all of their component."""
    import time

    rng = np.random.Generator(np.random.PCG64(5))
    passage, groups = np.arange(12), rng.integers(1000, 3000, (8000, 1)) * 100
    texts = np.hstack([np.broadcast_to(passage, (8000, 12)), groups + np.arange(4), 10**9 + np.arange(8000 * 8).reshape(8000, 8)]).astype(np.uint64)
    began = time.process_time()
    roots = neardup.jaccard_sets(texts.reshape(-1), np.full(8000, 24), 0.5)
    took = time.process_time() - began
    _, first, group = np.unique(groups, return_index=True, return_inverse=True)
    assert (roots == first[group.reshape(-1)]).all()
    assert took < 3


def test_a_task_trains_one_shard(spark):
    """op6_lm (F2): shards went to tasks by a hash of their numbers, so that some tasks had several in turn and others none."""
    table = spark.range(4000).select(F.xxhash64("id").alias("h"), F.lit(1).alias("n"))
    held = defaultdict(set)
    for r in lm.by_shard(table, 14).select(F.spark_partition_id().alias("task"), F.pmod(F.xxhash64("h"), F.lit(14)).alias("shard")).distinct().collect():
        held[r["task"]].add(r["shard"])
    assert len(held) == 14 and all(len(s) == 1 for s in held.values())


def test_steps_of_few_lanes_are_cheap():
    """op6_lm (F2, check): where only long texts are left, a step's calls cost more than its numbers. Measured in calls of numpy."""
    import time

    rng = np.random.default_rng(2)
    p = lm.fresh(1000 / (1 + np.arange(lm.VOCABULARY)))
    x, starts = rng.integers(0, lm.VOCABULARY, (1024, 2)), np.zeros((1024, 2), bool)
    starts[0] = True
    small = np.ones((2 * lm.HIDDEN, 2), np.float32)

    def least(f):
        times = []
        for _ in range(5):
            began = time.thread_time()
            f()
            times.append(time.thread_time() - began)
        return min(times)

    call = least(lambda: [np.tanh(small, out=small) for _ in range(20_000)]) / 20_000
    step = least(lambda: lm.gradients(p, x, x, starts, ~starts | True, np.zeros((lm.HIDDEN, 2), np.float32))) / 1024
    assert step < 57 * call


def test_batches_are_scored_together(spark, monkeypatch):
    """op6_lm (check): each batch of a task was scored by itself, and waited for its longest text in few lanes; results are the same."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + k * k) % 97}" for k in range(1 + i % 40))) for i in range(500)], "doc_id long, text string").coalesce(1)
    words = lm.vocabulary(docs)[0]
    table = lm.encoded(docs, words, lm.spelling_model(docs, words))
    params = lm.fresh(lm.token_counts(table, lm.FIRST_WORD + len(words)))
    found = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for most in (0, lm.SCORED):
            monkeypatch.setattr(lm, "SCORED", most)
            found.append({r["doc_id"]: (r["n_tokens"], r["log_likelihood"]) for r in lm.score(table, params).collect()})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found[1]) == 500 and all(found[0][i][0] == n and abs(found[0][i][1] - x) < 1e-3 * n for i, (n, x) in found[1].items())


def test_toxicity_stage_reads_texts_in_small_batches(spark, tmp_path, monkeypatch):
    """pipeline (check): the stage's texts went to Python 10,000 rows at once, whatever their size, in memory of the JVM and of the worker."""
    spark.range(6000).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 700) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = f"{tmp_path}/seen"

    class Noted:
        def score(self, texts):
            with open(seen, "a") as f:
                f.write(f"{texts.buffers()[2].size}\n")
            return np.zeros(len(texts))

    monkeypatch.setattr(toxicity, "fit_on", lambda *_: Noted())
    kept = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    kept.write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6000
    with open(seen) as f:
        assert max(map(int, f)) < 17 << 20


def test_strings_of_words_are_made_without_an_index_for_each_byte():
    """op6_lm (check): each of four bytes was looked up by an index of its own. Measured in memory held at once for a byte of text."""
    import tracemalloc

    from foliomill.llm.common import Words

    texts = ["ab \x00c", "é ü ß 日本語", "", None, "  x\n", "q" * 100 + " zz"]
    w = Words(pa.array(texts))
    want = [sum(b << (8 * k) for k, b in enumerate(reversed(word[max(0, i - lm.ORDER) : i + 1]))) for t in texts if t for word in t.encode().split() for i in range(len(word))]
    assert lm._strings(w.raw, w.start, w.end).tolist() == want
    long = pa.array(["some words of a text " * 12_000])
    w = Words(long)
    tracemalloc.start()
    strings = lm._strings(w.raw, w.start, w.end)
    of_strings = tracemalloc.get_traced_memory()[1] / len(strings)
    tracemalloc.stop()
    assert of_strings < 38
