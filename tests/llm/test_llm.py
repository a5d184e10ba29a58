"""Each operator against brute force on small tables with null, empty, long, repeated and clashing values."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from vertexflow.llm import components, exact_dedup, exact_math, language, line_dedup, mixing, packing, quality, quality_rules, sharding, simhash, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
SCHEMA = "doc_id long, text string, lang string, source string, size string, fp string"


def text(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(5 + 7 * i % 90, i), "ab"[i % 2], f"s{i % 3}" if i % 4 else None) for i in range(40)]
    rows += [(100, rows[7][1], "a", "s1"), (101, rows[7][1].replace(" ", " \n\t", 2), None, "s2"), (102, None, None, None), (103, "", "a", "s1"), (104, text(9000, 5), "b", "s0")]
    rows += [(None, "one two", "a", "s0"), (7, rows[7][1], "a", "s1"), (105, "  \n ", "a", "s9")]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("bits", [64, 4])
def test_exact_groups(docs, nothing, bits):
    by = {}
    for r in docs.collect():
        by.setdefault(norm(r["text"]), []).append(r["doc_id"])
    got = exact_dedup.exact_groups(docs, bits=bits).collect()
    want = {hashlib.sha256(t.encode()).hexdigest(): (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in by.items()}
    assert len(got) == docs.count() and {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in got} == want
    assert sum(r["kept"] for r in got) == len(by)
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.deduplicate(docs).count() == len(by)


def test_fingerprint():
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0
    import xxhash

    words = b"A b  c d".lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(2)]
    assert simhash.fingerprint(b"A b  c d") == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(b"one") == xxhash.xxh64_intdigest(b"one", 42)


@pytest.mark.parametrize("bucket", [256, 1])
def test_links_match_all_pairs(spark, bucket):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), k)) for s in seeds for k in (0, 1, 2, 3, 5) for _ in range(3)})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    frame = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    found = {r["node"]: r["root"] for r in components.components(simhash.links(frame, bucket)).collect()}
    for a, b in combinations(fps, 2):
        ra, rb = (found.get(simhash.signed(x), simhash.signed(x)) for x in (a, b))
        assert (ra == rb) == (find(a) == find(b))


def test_near_groups(docs, nothing):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert got[100] == got[101] == 7 and got[102] == got[103] == got[105] == 102
    assert simhash.near_groups(nothing).count() == 0
    assert simhash.deduplicate(docs).filter("doc_id = 7").count() == 1


def test_lines(spark, nothing):
    rows = [(i, f"own line {i}\nshared text\n\nshared text" if i < 9 else f"own {i}\nrare line", f"s{i}" if i < 8 else "s0", "z") for i in range(12)]
    rows += [(20, None, None, "z"), (21, "", "s1", "z")]
    got = {r["doc_id"]: r for r in line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines string")).collect()}
    assert got[0]["text"] == "own line 0\nshared text\n" and got[3]["text"] == "own line 3\n" and got[3]["n_removed"] == 2
    assert got[10]["text"] == "own 10\nrare line" and got[20]["text"] is None and got[21]["n_lines"] == 1
    assert line_dedup.cleaned(nothing).count() == 0


def test_shards_fit(docs, nothing):
    rows = sharding.sharded(docs, limit=3000).collect()
    size = {}
    for r in rows:
        key = (r["shard_depth"], r["shard_prefix"])
        size[key] = size.get(key, 0) + len((r["text"] or "").encode())
    assert len(rows) == docs.count()
    assert all(size[r["shard_depth"], r["shard_prefix"]] == r["shard_bytes"] for r in rows)
    assert all(r["shard_bytes"] <= 3000 or r["doc_id"] == 104 for r in rows)
    assert sharding.sharded(nothing).count() == 0


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    out = packing.packed(docs).collect()
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    long = next(r["text"] for r in docs.collect() if r["doc_id"] == 104)
    assert sum(r["length"] for r in out if r["doc_id"] == 104) == len(whole.encode(long, add_special_tokens=False).ids) + 1
    assert len(by) == packing.lower_bound(np.array([r["length"] for r in out]), 4096)
    assert packing.packed(nothing).count() == 0


def test_encoder_equals_whole_texts():
    import pyarrow as pa

    encoder = packing.Encoder(packing.VOCABULARY, 50)
    rng, signs = random.Random(1), [*"abXY.,'!éÉß日 \n\té̇İ<|>12½", "<|endoftext|>", "'s", "can't"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 20))) for _ in range(3000)]
    for at in range(0, 3000, 300):
        part = texts[at : at + 300]
        ids, ends = encoder.encode(pa.array(part))
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 101, 60)
        bins = packing.best_fit(lengths, 100)
        assert np.bincount(bins, weights=lengths).max() <= 100
        assert -(-lengths.sum() // 100) <= packing.lower_bound(lengths, 100) <= bins.max() + 1


def test_measures(docs):
    for r in quality_rules.measures(docs, keep=("doc_id", "text")).collect():
        t = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + j for i, g in enumerate(grams) if len(words) < 500 and grams.count(g) > 1 for j in range(5)}
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert len(words) >= 500 or r["n_repeat_words"] == len(covered)


def test_distributions(spark):
    from math import comb

    cases = [(0, 10, 0.3), (2, 40, 0.2), (7, 400, 0.05), (9, 10, 0.3)]
    df = spark.createDataFrame(cases, "k long, n long, p double").withColumn("t", exact_math.binomial_tail(F.col("k"), F.col("n"), F.col("p")))
    for r in df.collect():
        exact = sum(comb(r["n"], j) * r["p"] ** j * (1 - r["p"]) ** (r["n"] - j) for j in range(r["k"] + 1))
        assert r["t"] == pytest.approx(exact if r["k"] < r["n"] * r["p"] else 1.0, rel=1e-7)
    us = spark.range(400).select(((F.col("id") + 0.5) / 400).alias("u"))
    got = [r[0] for r in us.select(exact_math.hypergeometric_draw(F.lit(30), F.lit(12), F.lit(10), F.col("u"))).collect()]
    for x in range(11):
        assert got.count(x) / 400 == pytest.approx(comb(12, x) * comb(18, 10 - x) / comb(30, 10), abs=0.006)


def filled(size_of):
    """Target of each source: weights 5, 2, 1 by code point, 150 % of all words, at most twice a source's own, the excess shared anew."""
    names = sorted(size_of, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(size_of.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * size_of[s]}
        for s in full or free:
            target[s] = 2 * size_of[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    return target


def test_mix(docs, nothing):
    sizes = mixing.sized(docs).select("doc_id", "source", "size").cache()
    sources, blocks = mixing.plan(sizes, shard_words=500, block_docs=4)
    rows = mixing.counted(sizes, sources, blocks).collect()
    size_of = {}
    for r in rows:
        size_of[r["source"]] = size_of.get(r["source"], 0) + r["size"]
    want = filled(size_of)
    assert len(rows) == docs.count() and all(r["times"] <= 2 for r in rows)
    assert all(r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == size_of[r["source"]] for r in rows)
    for s in size_of:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["times"] * r["size"] for r in own) - want[s]) <= max(r["size"] for r in own)
    assert all(len(r["shards"]) >= r["times"] for r in rows if r["times"])

    def again():
        return sorted(map(str, mixing.mixed(docs, shard_words=500, block_docs=4).collect()))

    assert again() == again() and len(again()) == sum(r["times"] for r in rows)
    assert mixing.mixed(nothing).count() == 0


#: Every name that an operator uses for itself.
INNER = "size times shards target source_size copies sid cut n_blocks _block mix_shard removed _id _own _text _row _body _lines _c0 _prefix0 _depth0 _bytes0 _hash _bytes _key _copy _shard fp body root least node first _source _sha _stays chunks h digest n_lines n_removed shard_prefix shard_depth shard_bytes".split()


def test_clashing_columns(docs):
    from pyspark.sql.types import IntegerType

    wide = docs.drop("size", "fp").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in INNER}).withColumn("n_chars", F.length("text").cast(IntegerType()))
    outs = {
        "lines": (line_dedup.cleaned(wide), ("n_lines", "n_removed")),
        "line stage": (line_dedup.stage(None, wide, ""), ("n_lines", "n_removed")),
        "shards": (sharding.sharded(wide, limit=3000), ("shard_prefix", "shard_depth", "shard_bytes")),
        "mix": (mixing.mixed(wide, shard_words=500), ("mix_shard",)),
        "exact": (exact_dedup.deduplicate(wide), ()),
        "simhash": (simhash.stage(None, wide, ""), ()),
    }
    for name, (out, own) in outs.items():
        assert set(wide.columns) <= set(out.columns), name
        kept = [c for c in INNER if c not in own]
        rows = out.select("doc_id", *[F.col(f"`{c}`") for c in kept]).collect()
        assert rows and all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in rows for c in kept), name
    assert mixing.stage(None, wide, "").columns == wide.columns
    assert language.identify(wide, language.Model([], language.codewords(1), np.zeros((1 << language.BITS, 7), np.float32), np.zeros(7), np.ones(7))).count() == docs.count()
    assert packing.stage(None, wide, "").columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_near_dedup_keeps_one_of_each_component(spark):
    a, b, c = text(60, 901), text(60, 902), text(60, 903)
    rows = [(3, a), (7, a), (7, b), (None, a), (None, c), (None, c + " "), (None, b), (9, b), (9, b), (11, None), (12, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], (r["text"] or "").strip()) for r in simhash.deduplicate(frame).collect()), key=str)
    assert got == sorted([(3, a), (7, b), (11, ""), (None, c)], key=str)


@pytest.mark.parametrize("rounds", [3, 0])
def test_wide_links_against_all_pairs(spark, rounds):
    rng, rows = random.Random(5), []
    for i in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(150)]
        rows.append(base)
        for _ in range(4):
            copy = list(base)
            for at in rng.sample(range(150), rng.choice([1, 2, 3, 6])):
                copy[at] = f"x{rng.randrange(400)}"
            rows.append(copy)
    texts = [*map(" ".join, rows), None, "", "two words", "two other"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raws = [(t or "").encode() for t in texts]
    fps, sketches, sets = ([f(t) for t in raws] for f in (simhash.fingerprint, simhash.sketch, lambda t: set(simhash._hashes(t, 5).tolist())))
    masks = simhash.block_masks(simhash.FAR_BLOCKS, simhash.FAR_BLOCKS - simhash.FAR_AGREE)
    root, alike, linked = list(range(len(texts))), 0, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        bits = fps[a] ^ fps[b]
        apart = sum((x ^ y).bit_count() for x, y in zip(sketches[a], sketches[b], strict=True))
        similar = len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        meet = bits.bit_count() <= simhash.FAR and not all(bits & m for m in masks)
        link = bits.bit_count() <= 3 or (meet and (apart <= simhash.SURE or (apart <= simhash.DOUBTFUL and similar)))
        alike, linked = alike + similar, linked + (similar and link)
        if link:
            root[find(a)] = find(b)
    rows = simhash.fingerprints(frame, body=True).cache()
    roots = {r["fp"]: r["root"] for r in simhash._rooted_far(rows, frame, "text", rounds).collect()}
    got = [roots[simhash.signed(f)] for f in fps]
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a, b in combinations(range(len(texts)), 2))
    assert linked >= 0.6 * alike > 0
    kept = {r["doc_id"] for r in simhash.deduplicate(frame, wide=True).collect()}
    assert kept == {min(i for i in range(len(texts)) if find(i) == find(r)) for r in range(len(texts))}


def extendible(items, limit, bits):
    """(prefix, depth, bytes) of each (hash, size), splitting a bucket that is too large on one more bit."""
    out = {}

    def place(part, depth):
        total = sum(n for _, n in part)
        if total <= limit or len({h for h, _ in part}) == 1:
            for h, _ in part:
                out[h] = (h >> (bits - depth), depth, total)
        else:
            for bit in (0, 1):
                side = [x for x in part if x[0] >> (bits - depth - 1) & 1 == bit]
                if side:
                    place(side, depth + 1)

    place(items, 0)
    return out


@pytest.mark.parametrize("levels", [12, 3])
def test_directory_over_several_rounds(spark, monkeypatch, levels):
    monkeypatch.setattr(sharding, "BITS", levels)
    frame = spark.createDataFrame([(i, text(1 + i % 9, i)) for i in range(600)] + [(5, text(6, 5))], "doc_id long, text string")
    items = [(r["_hash"], r["_bytes"]) for r in sharding.hashed(frame).collect()]
    want = extendible(items, 60, sharding.HASH_BITS)
    assert max(d for _, d, _ in want.values()) > levels or levels == 12
    got = sharding.sharded(frame, limit=60)
    rows = sharding.hashed(got).collect()
    assert len(rows) == 601 and all((r["shard_prefix"], r["shard_depth"], r["shard_bytes"]) == want[r["_hash"]] for r in rows)


def test_cutoffs_against_exact_binomials(spark):
    """Strata of 3000, 764 and 300 good rows: large ones certify cutoffs, small ones none."""
    from math import comb

    rng, rows = random.Random(8), []
    for stratum, n in (("a", 3000), ("b", 764), (None, 300)):
        for i in range(n):
            rows.append((stratum, *(rng.choice([0.0, 0.0, 0.004, 0.015, 0.08]) if i % 20 == 0 else 0.0 for _ in range(3)), False, True))
    rows += [("a", 0.9, 0.9, 0.9, True, True), ("b", 0.9, 0.9, 0.9, False, False)]
    names = list(quality_rules.RULES)
    holdout = spark.createDataFrame(rows, f"lang string, {', '.join(f'{r} double' for r in names)}, base_failed boolean, good boolean")
    got = {r["lang"]: r for r in quality_rules.cutoffs(holdout, "lang").collect()}
    p, level = quality_rules.LIMIT / 3, quality_rules.DELTA / (3 * 3 * len(quality_rules.GRID))
    certified = 0
    for stratum in ("a", "b", None):
        good = [r for r in rows if r[0] == stratum and r[5] and not r[4]]
        for j, rule in enumerate(names, 1):
            fit = []
            for c in quality_rules.GRID:
                k, n = sum(r[j] > c for r in good), len(good)
                tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                if k < n * p and tail <= level:
                    fit.append(c)
            assert got[stratum][f"max_{rule}"] == min(fit, default=None), (stratum, rule)
            certified += bool(fit)
    assert certified >= 3 and got[None]["max_repeat_share"] is None


def test_certificates_and_rows_without_ids(spark):
    pieces = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (1 + F.col("id") % 7).alias("length"), F.lit(9).cast("long").alias("ids_crc32"))
    placed = packing.pack(pieces, 20, 500).cache()
    assert placed.count() == 3000 and placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 20").isEmpty()
    rows = packing.certificates(placed, 20).collect()
    assert len(rows) >= 5 and all(r["gap"] == r["bins"] - r["bound"] >= 0 for r in rows)
    assert sum(r["bins"] for r in rows) == placed.select("sequence_id").distinct().count()


def test_pieces_against_whole_texts(docs):
    import zlib

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    got = {}
    for r in packing.pieces(docs, capacity=50).collect():
        got.setdefault((r["doc_id"], r["start"] and None), []).append(r)
    rows = packing.pieces(docs.dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL"), capacity=50).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.dropDuplicates(["doc_id"]).collect()}
    for i in {r["doc_id"] for r in rows}:
        ids = [*whole.encode(texts[i], add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in own] == [
            (s, len(ids[s : s + 50]), zlib.crc32(np.array(ids[s : s + 50], "<u4").tobytes())) for s in range(0, len(ids), 50)
        ]


def test_other_vocabularies_encode_whole_texts():
    import pyarrow as pa

    encoder = packing.Encoder("byte_bpe_50k.json")
    part = ["Two  words\n and a_tail!", "", "it's 12½"]
    ids, ends = encoder.encode(pa.array(part))
    assert not encoder.splits
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def test_ftrl_against_its_definition():
    """Weights as the closed form gives them from the sums of gradients and of their squares, coordinate by coordinate."""
    rng = random.Random(2)
    rows = [(sorted(rng.sample(range(12), 4)), rng.randint(0, 1)) for _ in range(60)]
    learner = toxicity.Ftrl(4, alpha=0.7, beta=1.0, l1=0.3, l2=0.2)
    z, n, w = [0.0] * 17, [0.0] * 17, [0.0] * 17
    for slots, y in rows:
        at = [*slots, 16]
        learner.learn(np.array(at), y, 1.5)
        for i in at:
            l1 = 0.0 if i == 16 else 0.3
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((1.0 + n[i] ** 0.5) / 0.7 + 0.2)
        g = 1.5 * (1 / (1 + np.exp(-sum(w[i] for i in at))) - y)
        for i in at:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.7 * w[i]
            n[i] += g * g
    assert learner.z.tolist() == pytest.approx(z) and learner.n.tolist() == pytest.approx(n)
    assert any(abs(x) <= 0.3 for x in z[:12])


def test_toxic_scores_against_sets_of_slots():
    texts = [text(30, 70).encode(), b"", None, text(3, 71).encode(), b"one"]
    slots = sorted({int(s) for t in texts for b in toxicity.blocks([t]) for s in toxicity.word_grams(b, 10, toxicity.SKIPS)[0]})
    model = toxicity.Model(10, np.array(slots[::2]), np.linspace(-1, 1, len(slots[::2])).astype(np.float32), 0.2)
    weight = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True))
    for t, got in zip(texts, toxicity.score_texts(model, model.table(), texts), strict=True):
        own = {int(s) for b in toxicity.blocks([t]) for s in toxicity.word_grams(b, 10, toxicity.SKIPS)[0]}
        assert got == pytest.approx(1 / (1 + np.exp(-(sum(weight.get(s, 0.0) for s in own) + 0.2))), rel=1e-5)


def test_decoding_against_every_codeword():
    rng = np.random.default_rng(4)
    code = language.codewords(3)
    m = language.Model(["x", "y", "z"], code, rng.normal(size=(1 << language.BITS, code.shape[1])).astype(np.float32) * 30, rng.normal(size=code.shape[1]), rng.uniform(0.5, 3, code.shape[1]))
    texts = [text(20, i).encode() for i in range(150)] + [b"", None, b"abc"]
    best, sure, close = language.predict_texts(m, texts)
    for t, b, s, c in zip(texts, best, sure, close, strict=True):
        bits = language._counts(next(iter(language.blocks([t]))))[0] @ m.weights + m.bias
        loss = [sum(m.trust[j] * np.log1p(np.exp(-bits[j] * w[j])) for j in range(len(w))) / m.trust.mean() for w in code]
        p = np.exp(min(loss) - np.array(loss))
        p = sorted(p / p.sum())[::-1]
        assert b == int(np.argmin(loss)) and s == pytest.approx(p[0], rel=1e-4) and c == (p[0] - p[1] < language.LEAD)


def test_quality_scores_against_mean_vectors():
    rng = np.random.default_rng(5)
    m = quality.Model(rng.normal(size=(1 << quality.BITS, quality.DIM)).astype(np.float32), rng.normal(size=(2, quality.DIM)).astype(np.float32), np.array([0.1, -0.2], np.float32))
    texts = [text(12, 5).encode(), b"a", text(40, 6).encode()]
    for t, got in zip(texts, quality.score_texts(m.table(), m.offset(), texts), strict=True):
        slots, share = quality.features([t])[0]
        logits = m.output @ (share @ m.vectors[slots]) + m.bias
        p = np.exp(logits - logits.max())
        assert got == pytest.approx((p / p.sum())[1], rel=1e-3)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of documents with toxic ones, boilerplate, copies, nulls, empty and long texts, and labels."""
    folder = tmp_path_factory.mktemp("planted")
    clean = [text(50, 300 + i) for i in range(80)]
    rows = [(i, t + "\nfooter of all sites", "en", f"s{i % 6}") for i, t in enumerate(clean)]
    rows += [(100 + i, f"{text(25, 500 + i)} scum scum {text(9, i)}", "en", f"s{i % 6}") for i in range(40)]
    rows += [(200, rows[3][1], "en", "s1"), (201, clean[3].upper(), "en", "s1"), (202, None, None, None), (203, "", "en", "s0"), (204, text(6000, 9), "en", "s2"), (None, text(45, 777), "en", "s0"), (7, rows[7][1], "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int").withColumn("size", F.lit("x"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 140)) for i in [*range(80), *range(100, 140)]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline(spark, planted, nothing, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{planted}/documents.parquet").cache()
    first, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, planted).write.parquet(path)
        before, docs = docs, spark.read.parquet(path).cache()
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == first, name
    ids = {name: sorted((r["doc_id"] for r in rows), key=str) for name, rows in kept.items()}
    assert not any(100 <= (i or 0) < 140 for i in ids["toxicity"]) and len(ids["toxicity"]) == 87
    texts = {r["doc_id"]: r["text"] for r in kept["line_dedup"]}
    assert ids["line_dedup"] == ids["toxicity"] and "footer" in texts[0] and not any("footer" in (texts[i] or "") for i in range(1, 80))
    assert texts[202] is None and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept["line_dedup"])
    near = {}
    for r in kept["line_dedup"]:
        near.setdefault(simhash.fingerprint((r["text"] or "").encode()), []).append(r["doc_id"])
    assert len({200, 201, 3} & set(ids["simhash_near_dedup"])) == 1 and ids["simhash_near_dedup"].count(7) == 1
    assert len(ids["simhash_near_dedup"]) == len(set(map(str, ids["simhash_near_dedup"]))) and len(ids["simhash_near_dedup"]) <= len(near)
    size_of, taken, alone = {}, {}, {(r["doc_id"], r["text"]): r["source"] for r in kept["simhash_near_dedup"]}
    for (_, t), s in alone.items():
        size_of[s] = size_of.get(s, 0) + len((t or "").split())
    for r in kept["source_mixing"]:
        assert alone[r["doc_id"], r["text"]] == r["source"]
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
    largest = {s: max(len((t or "").split()) for (_, t), own in alone.items() if own == s) for s in size_of}
    assert all(abs(taken.get(s, 0) - t) <= largest[s] for s, t in filled(size_of).items())
    whole = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    assert sum(r["length"] for r in kept["packing"]) == sum(len(whole.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    rows = sorted(map(str, corpus_pipeline.run(spark, planted).collect()))
    assert len(rows) == len(kept["packing"])
    empty = f"{tmp_path}/empty"
    spark.read.parquet(f"{planted}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{planted}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_every_query_on_planted_and_empty_tables(spark, planted, tmp_path):
    """Null, empty, long, repeated and clashing rows go through every query; an empty table gives none."""
    from vertexflow.llm import catalog

    n = spark.read.parquet(f"{planted}/documents.parquet").count()
    for t in ("documents", "labels"):
        spark.read.parquet(f"{planted}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in catalog.QUERIES.items():
        rows = query(spark, planted).collect()
        assert len(rows) == n or (name == "op6_packing" and len({r["doc_id"] for r in rows}) == n - 1 and len(rows) >= n), name
        assert query(spark, str(tmp_path)).count() == 0, name


def test_classifiers_learn(spark, docs, nothing):
    bad, good = [f"{text(30, i)} scum {text(9, i)}" for i in range(60)], [text(40, 100 + i) for i in range(60)]
    rows = [(i, t, int(t in set(bad)), "xy"[t in set(bad)]) for i, t in enumerate(bad + good)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    model = toxicity.train(table, table)
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.score(table, model).collect()}
    assert min(out[i] for i in range(60)) > 0.7 > 0.5 > max(out[i] for i in range(60, 120))
    assert toxicity.filtered(table, model).count() == 60
    assert all(0 <= r["toxicity"] <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(nothing, toxicity.train(nothing, table.limit(0))).count() == 0
    junk = spark.createDataFrame([(i, t.replace(" ", "## ") if i % 2 else t, 1 - i % 2) for i, t in enumerate(good)], "doc_id long, text string, quality int")
    scored = quality.score(junk, quality.train(junk, junk)).collect()
    assert all((r["quality"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in scored)


@pytest.mark.parametrize("texts", [[b"alpha beta", b""], [b"alpha beta", None], [None], [b"", None, b""], [b"", b"alpha beta", b"gamma", None, b"alpha beta"]])
def test_quality_of_empty_texts(texts):
    table = np.random.default_rng(2).normal(size=1 << quality.BITS).astype(np.float32)
    got = quality.score_texts(table, 0.3, texts)
    for t, x in zip(texts, got, strict=True):
        slots, share = quality.features([t])[0]
        assert x == pytest.approx(1 / (1 + np.exp(-(float(share @ table[slots]) + 0.3))), rel=1e-4)


def test_quality_scores_every_row(spark, docs, nothing):
    rows = [(i, text(40, i).replace(" ", "## ") if i % 2 else text(40, i), 1 - i % 2) for i in range(20)]
    junk = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(junk, junk)
    out = quality.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["quality"] <= 1 for r in out)
    none = 1 / (1 + np.exp(-model.offset()))
    last = spark.createDataFrame([(1, "alpha beta"), (2, "")], "doc_id long, text string").coalesce(1)
    empty = spark.createDataFrame([(1, None), (2, ""), (3, None)], "doc_id long, text string").coalesce(1)
    assert quality.score(last, model).filter("doc_id = 2").head()["quality"] == pytest.approx(none)
    assert [r["quality"] for r in quality.score(empty, model).collect()] == pytest.approx([none] * 3)
    assert quality.score(nothing, model).count() == 0


def test_language(spark, docs, nothing):
    fr, en = ["le chat est sur la table et il dort", "nous allons manger ce soir avec eux"], ["the cat is on the table and sleeps", "we will eat this evening with them"]
    rows = [(i, " ".join(random.Random(i).sample(s, 2)), n) for i in range(40) for n, s in (("fr", fr), ("en", en))]
    table = spark.createDataFrame([(k, t, n) for k, (_, t, n) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.train(table)
    assert all(r["lang"] == r["lang_pred"] for r in language.identify(table, model).collect())
    out = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert out[102] == out[103] == out[105] == "und" != out[1]
    assert language.identify(nothing, language.train(nothing)).count() == 0
    code = language.codewords(5)
    assert len({tuple(c) for c in code.tolist()}) == 5


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The driver gets the model that a fit on its own would make, but makes none itself."""
    rows = [(f"d{i:03}", ("bad worse worst " if i % 3 == 0 else "fine good better ") * 3 + f"word{i % 7}", int(i % 3 == 0)) for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id string, text string, toxic int")
    want = toxicity.fit([t.encode() for _, t, _ in rows], [y for _, _, y in rows])

    def refuse(*_):
        raise AssertionError("the learner is on the driver")

    monkeypatch.setattr(toxicity, "Ftrl", refuse)
    got = toxicity.train(table, table)
    assert len(want.slots) and got.bits == want.bits and got.bias == want.bias
    assert np.array_equal(got.slots, want.slots) and np.array_equal(got.weights, want.weights)
