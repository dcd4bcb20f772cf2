"""The corpus operators against brute force, round trips and held-out labels, and on nulls, blanks, ties and empty tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import audio, language, lm, mixing, near, packing, suffix, topk, toxicity, urls
from marginalia.llm.common import word_runs
from marginalia.llm.entries import RULES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, size int"


def frame(spark, texts, ids=None, langs=None, sources=None):
    """Documents with extra columns whose names the operators use inside."""
    n = len(texts)
    ids = ids or list(range(n))
    return spark.createDataFrame([(ids[i], t, (langs or ["en"] * n)[i], (sources or ["a"] * n)[i], len(t or ""), 0.5, 7, 1) for i, t in enumerate(texts)], DOCS)


def words(n, seed, vocabulary=400):
    dice = random.Random(seed)
    return " ".join(f"w{dice.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " \n", "one", "Two words", "é" * 400, "x" * 900]


def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- packing


def test_packing_is_gapless_and_cuts_only_long_documents(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, *(words(random.Random(i).randrange(1, 900), i) for i in range(60)), words(6000, 1), "a <|endoftext|> B", words(300, 5), words(300, 5)]
    ids = [*range(len(texts) - 1), len(texts) - 2]  # a repeated row
    rows = packing.pack(frame(spark, texts, ids), tokenizer_path()).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    total = 0
    for i, text in zip(ids, texts, strict=True):
        tokens = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(tokens)
        own = {r.piece: r for r in pieces[i]}
        assert sorted(own) == list(range(-(-len(tokens) // 4096)))
        for k, r in own.items():
            part = tokens[4096 * k : 4096 * (k + 1)]
            assert (r.start, r.length, r.ids_crc32) == (4096 * k, len(part), zlib.crc32(part.tobytes()))
    assert len(sequences) <= -(-total // 4096) + 1
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0


def test_only_words_with_marks_are_cut(monkeypatch):
    """The library's ids of whole texts, with a regular expression's work for few words; islands get a task each."""
    seen, extract = [], packing.pc.extract_regex
    monkeypatch.setattr(packing.pc, "extract_regex", lambda words, pattern: seen.append(len(words)) or extract(words, pattern))
    texts = ["one two, three. one; FOUR! five?! ,;: ... x1. x|y, ü. \u00fcber, n'est. don't, it's", "plain words without marks " * 3, "", "a.b, c.!"]
    tokens = packing.Tokens(tokenizer_path())
    flat, cuts = tokens.ids(pa.array(texts))
    for text, a, b in zip(texts, cuts, cuts[1:], strict=False):
        assert flat[a:b].tolist() == [*tokens.tokenizer.encode(text, add_special_tokens=False).ids, packing.END]
    assert sum(seen) < 14


def test_islands_are_not_one_task(spark):
    items = [(1, 0, 0, 1000 + k, 0, None) for k in range(5)]
    shards = spark.createDataFrame([(k, items) for k in range(40)], packing.SHARDS)
    first = packing.evolved(shards, 4096, 40)
    assert len({r.shard for r in first.collect()}) == 40
    assert "hashpartitioning(shard#" in (plan := first._jdf.queryExecution().toString()) and "REPARTITION_BY_NUM" in plan


def test_packing_returns_the_ids(spark):
    rows = packing.pack(frame(spark, [words(50, 1)]), tokenizer_path(), with_ids=True).collect()
    assert zlib.crc32(rows[0].ids) == rows[0].ids_crc32


def test_crossover_keeps_every_piece_once():
    dice = random.Random(3)
    sizes = [dice.randrange(1, 60) for _ in range(200)]
    island = packing.evolve(sizes, 100, 1, best_fit=True)
    assert island.crossovers == packing.GENERATIONS
    for p in island.people:
        owner = p.owners(200)
        fill = np.bincount(owner, sizes)
        assert min(owner) == 0 and fill.max() <= 100 and (fill > 0).all() and (100 - fill).tolist() == p.left
    best = island.people[0].owners(200)
    again = packing.evolve(sizes, 100, 2, [list(range(200))], best)
    assert again.migrants == 1 and len(again.people[0].bins) <= max(best) + 1
    assert packing.evolve([5], 100, 1).people[0].bins == [[0]]


def triples(n, seed):
    """Sizes of n triples that fill a bin of 1000 each."""
    dice, out = random.Random(seed), []
    while len(out) < 3 * n:
        a = dice.randrange(260, 480)
        b = dice.randrange(260, 480)
        out += [a, b, 1000 - a - b]
    return out


def test_evolution_beats_best_fit_where_that_misses_the_bound():
    sizes = triples(60, 4)
    alone = packing.Packing([], [])
    alone.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 1000)
    assert len(alone.bins) > 60
    assert len(packing.evolve(sizes, 1000, 5, best_fit=True, generations=60).people[0].bins) < len(alone.bins)


def test_every_shard_evolves(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    shards = docs.mapInArrow(lambda it: packing._pieces(it, tokenizer_path(), 4096, False), packing.SHARDS)
    rows = packing.evolved(shards, 4096).collect()
    assert rows and all(r.crossovers == packing.EPOCHS * packing.GENERATIONS for r in rows)
    assert sum(r.children for r in rows) > 0 and sum(r.migrants for r in rows) > 0


def test_evolution_goes_on_beyond_the_first_children():
    """Pieces that fill bins badly: an epoch ends with fewer bins than six generations of six people gave, or fuller ones."""
    import random

    dice = random.Random(5)
    for _ in range(3):
        sizes = [dice.randrange(700, 2000) for _ in range(400)]
        few, whole = (packing.evolve(sizes, 4096, 7, best_fit=True, **more) for more in ({"generations": 6}, {}))
        rank = lambda island: (len(island.people[0].bins), -island.people[0].fitness(4096))
        assert rank(whole) < rank(few) and sorted(i for b in whole.people[0].bins for i in b) == list(range(400))


# -- search


def brute_topk(rows, k=5, every=50):
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(valid):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), j) for b, (j, v) in enumerate(valid) if b != a and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_search_is_exact(spark):
    dice = np.random.default_rng(1)
    rows = [(i, dice.standard_normal(6).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(60)]  # ties
    rows += [(None, [1.0] * 6), (400, None), (450, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (500, [float("nan")] * 6), (550, [float("inf")] * 6), (600, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(tuple(r) for r in topk.nearest(df.repartition(3)).collect())
    assert got == brute_topk(rows)
    assert topk.nearest(df.limit(0)).count() == 0
    assert topk.nearest(df.where("vec_id = 0")).count() == 0


def test_search_broadcasts_no_blocks(spark, monkeypatch):
    plans, stored = [], topk.stored
    monkeypatch.setattr(topk, "stored", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, label))
    df = spark.createDataFrame([(i, [i / 7, 1.0 - i]) for i in range(120)], "vec_id long, embedding array<double>")
    plans.append(topk.nearest(df)._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in p for p in plans)


def test_search_counts_repeated_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r)[1:] for r in topk.nearest(df).collect()) == [(1, 0, 65536), (1, 0, 65536), (2, 1, 32768), (2, 1, 32768)]


# -- toxicity


def test_toxicity_finds_held_out_texts(spark):
    dice = random.Random(5)
    texts, labels = [], []
    for i in range(900):
        w = words(60, i).split()
        if i % 4 == 0:
            for _ in range(4):
                w[dice.randrange(60)] = dice.choice(["vilely", "vilest", "dunce", "duncehead"])
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 9)], "doc_id long, toxic int")
    docs = frame(spark, [*texts, None, ""], [*range(900), None, 5000])
    rows = {r.doc_id: r for r in toxicity.score(docs, table).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in labels)
    assert np.mean([rows[i].predicted == y for i, y in labels if i in held]) > 0.97
    assert rows[5000].predicted == 0 and rows[None].predicted == 0
    kept = toxicity.keep_ordinary(docs, table)
    assert kept.columns == docs.columns and 600 < kept.count() < 720


def test_toxicity_ratios_equal_a_plain_model(spark):
    texts = [("the cat sat on the mat. the cat ran", 0), ("the dog sat! on the rug and the dog ran", 0), ("you vile dog, you vile cat", 1), ("vilest cat you vile thing you ran", 1), ("the end", 0), ("a vile end", 1)]
    rows = spark.createDataFrame([(t, y, i % toxicity.FOLDS) for i, (t, y) in enumerate(texts)], "text string, toxic int, fold int")
    model = toxicity.counted(rows.mapInArrow(toxicity._pairs, toxicity.PAIRS)).model()
    pairs = [collections.Counter(), collections.Counter()]
    clean = lambda t: [w.strip(".,!") for w in t.split()]
    for t, y in texts:
        w = clean(t)
        pairs[y].update(zip(["", *w], w))
    follows = lambda key: [collections.Counter(key(a, b) for a, b in p) for p in pairs]
    words, stems, types = follows(lambda a, b: b), follows(lambda a, b: b[:5]), follows(lambda a, b: a)
    tokens = [collections.Counter(), collections.Counter()]
    for c in (0, 1):
        for (a, _), n in pairs[c].items():
            tokens[c][a] += n

    def discount(counts):
        n1, n2 = (sum(v == k for v in counts.values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def level(counts):
        d, total = [discount(c) for c in counts], [sum(c.values()) for c in counts]
        kept = [sum(max(v - d[k], 0) for v in counts[k].values()) for k in (0, 1)]
        weight = max(1 - kept[k] / total[k] for k in (0, 1))
        return lambda k, x: (1 - weight) * max(counts[k][x] - d[k], 0) / kept[k], weight

    (stem, w0), (word, w1) = level(stems), level(words)
    all_stems, all_words = stems[0] + stems[1], words[0] + words[1]
    total = sum(all_stems.values()) + 0.5 * (1 << toxicity.STEM_BITS)

    def single(k, x):
        s = stem(k, x[:5]) + w0 * (all_stems[x[:5]] + 0.5) / total
        return word(k, x) + w1 * s * min(1, (all_words[x] + 0.5) / (all_stems[x[:5]] + 0.5))

    d2 = [discount(p) for p in pairs]

    def ratio(a, b):
        left = [tokens[k][a] - d2[k] * types[k][a] for k in (0, 1)]
        p = [single(k, b) for k in (0, 1)]
        if min(left) > 0:
            weight = max(1 - left[k] / tokens[k][a] for k in (0, 1))
            p = [(1 - weight) * max(pairs[k][a, b] - d2[k], 0) / left[k] + weight * p[k] for k in (0, 1)]
        return math.log(p[1] / p[0])

    import pyarrow as pa

    probe = "the vile cat ran, you unseen dog. vilest"
    own = clean(probe)
    got, strength = model.ratios(toxicity.Tokens.of(pa.array([" " + probe + " ", None])))
    assert got.tolist() == pytest.approx([ratio(a, b) for a, b in zip(["", *own], own)], rel=1e-4, abs=1e-5)
    assert strength.tolist() == pytest.approx([math.log(single(1, x) / single(0, x)) * words[1][x] / (words[1][x] + 4) for x in dict.fromkeys(own)], rel=1e-4, abs=1e-5)
    assert abs(got[5]) < 1e-5 or own[5] != "unseen"


@pytest.mark.parametrize(("sf", "least"), [("sf0.001", 0.0), ("sf0.01", 0.6)])
def test_toxicity_of_small_tables(spark, sf, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("flagged")).collect()
    flagged = {r.toxic: r.flagged for r in rows}
    assert flagged[0] < 0.05 and flagged[1] >= least


def test_toxicity_without_labels_gives_the_share(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty(spark), none).count() == 0
    assert toxicity.keep_ordinary(docs, none).count() == len(ODD)


# -- language models


def test_lm_base_and_counts_equal_brute_force(spark):
    texts = [*ODD, *(words(80, i, 90) for i in range(40)), "New unseen Words", words(80, 3, 90)]
    rows = {r.doc_id: r for r in lm.score(frame(spark, texts).repartition(3)).collect()}
    tokens = {i: (t or "").encode().lower().split() for i, t in enumerate(texts)}
    learn = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for i in learn for w in tokens[i])
    total, types = sum(counts.values()) + len(learn), len(counts) + 1
    for i, own in tokens.items():
        r = rows[i]
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in own) + math.log10((len(learn) + 1) / (total + types + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in learn, len(own) + 1, sum(counts[w] > 0 for w in own) + 1, total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert rows[0].score == pytest.approx(rows[1].score)
    assert lm.score(empty(spark)).count() == 0


def plain_contexts(text, i):
    """The last bytes before the i-th byte, for each order, and the word so far."""
    word = i
    while word and text[word - 1] > 32:
        word -= 1
    return [*((o, (b"\0" * 8 + text[:i])[-o:]) for o in lm.ORDERS), ("word", text[word:i])]


def plain_counts(texts):
    out = collections.defaultdict(collections.Counter)
    for t in texts:
        for i, byte in enumerate(t + b"\0"):
            for c in plain_contexts(t, i):
                out[c][byte] += 1
    return out


def plain_leanings(seen, byte):
    """Of each bit of a byte, as they are stored."""
    out = []
    for bit in range(8):
        own = sum(n for b, n in seen.items() if b >> 7 - bit == byte >> 7 - bit)
        both = sum(n for b, n in seen.items() if b >> 8 - bit == byte >> 8 - bit)
        out.append(max(-127, min(127, round(math.log((both - own + lm.PRIOR) / (own + lm.PRIOR)) * lm.SCALE))))
    return out


def plain_mixer(text, counts):
    """Natural log-probability of each byte, bit by bit; weights move where a step ends."""
    out, moves = [], {b for _, b in lm.steps(len(text) + 1)}
    weights = [[lm.START] * 8 for _ in range(len(lm.ORDERS) + 1)]
    change = [[0.0] * 8 for _ in weights]
    for i, byte in enumerate(text + b"\0"):
        if i in moves:
            weights = [[w + c for w, c in zip(*both, strict=True)] for both in zip(weights, change, strict=True)]
            change = [[0.0] * 8 for _ in weights]
        xs = [[v / lm.SCALE for v in plain_leanings(counts.get(c, {}), byte)] for c in plain_contexts(text, i)]
        log = 0.0
        for bit in range(8):
            odds = max(-lm.SURE, min(lm.SURE, sum(w[bit] * x[bit] for w, x in zip(weights, xs, strict=True))))
            wrong = 1 / (1 + math.exp(-odds))
            log += math.log(1 - wrong)
            for c, x in zip(change, xs, strict=True):
                c[bit] -= lm.RATE * wrong * x[bit]
        out.append(log)
    return out


def test_mixer_equals_a_plain_one_and_learns_online():
    even = lm.mix(np.array([4, 1]), [np.zeros((6, 8), np.int8)])
    assert even == pytest.approx([-8 * math.log(2)] * 5, rel=1e-4)
    learned = [(words(400, 3) + " abab").encode(), b""]
    texts = [b"x", (words(500, 3) + " other words " + "y" * 70).encode(), b"", b"a\0b"]
    counts = plain_counts(learned)
    ways = [[] for _ in range(len(lm.ORDERS) + 1)]
    for t in texts:
        for i, byte in enumerate(t + b"\0"):
            for way, c in zip(ways, plain_contexts(t, i), strict=True):
                way.append(plain_leanings(counts.get(c, {}), byte))
    ways = [np.array([*w, [0] * 8], np.int8) for w in ways]
    sizes = np.array([len(t) + 1 for t in texts])
    got = lm.mix(sizes, ways)
    assert got == pytest.approx([x for t in texts for x in plain_mixer(t, counts)], rel=2e-3, abs=2e-3)
    assert got.sum() > 0.5 * -8 * math.log(2) * sizes.sum()
    assert lm.mix(sizes, ways, rate=0.05).sum() != lm.mix(sizes, ways, rate=0.0).sum()
    assert [*lm.steps(40)] == [(0, 1), (1, 2), (2, 4), (4, 8), (8, 16), (16, 32), (32, 64)]


def test_pairs_meet_with_the_whole_corpus_counts():
    """Three blocks' pairs through the hash ranges: each gets back what all learning texts together say."""
    texts = [(words(60, 1) + " end").encode(), b"", words(60, 2).encode() + b" \xc3\xa9\0", words(300, 1).encode(), b"\xff" * 80]
    train = np.array([True, True, False, True, True])
    blocks, width, ranges = [[0, 1], [2, 3], [4]], lm.width_for(5000), 7
    rows, sent = [], {}
    for block, own in enumerate(blocks):
        for k, (keys, counts) in enumerate(lm.block_pairs([texts[i] for i in own], train[own], width)):
            sent[block, k] = keys
            where = lm.ranges_of(keys, width, ranges)
            assert where.tolist() == sorted(where.tolist()) and where.max() < ranges
            assert len({(c, r) for c, r in zip((keys >> np.uint64(8)).tolist(), where.tolist(), strict=True)}) == len(set((keys >> np.uint64(8)).tolist()))
            for r in range(ranges):
                pick = where == r
                if pick.any():
                    rows.append((block, lm.PAIRS + k, r, lm.planes(np.diff(keys[pick], prepend=np.uint64(0))), lm.planes(counts[pick])))
    rows.sort(key=lambda r: r[1:3])
    cells = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()], strict=True)]
    batch = pa.RecordBatch.from_arrays(cells, ["block", "kind", "part", "slots", "counts"])
    back = sorted((r["block"], r["kind"], r["part"], r["counts"]) for out in lm._lean([batch.slice(0, 5), batch.slice(5)]) for r in out.to_pylist())
    counts = plain_counts([t for t, learn in zip(texts, train, strict=True) if learn])
    for block, own in enumerate(blocks):
        mine = [texts[i] for i in own]
        for k, pairs in enumerate(lm.Stream(mine).pairs(width)):
            lean = np.concatenate([lm.unplanes(x, np.uint64) for b, kind, _, x in back if (b, kind) == (block, lm.PAIRS + k)]).view(np.int8).reshape(-1, 8)
            places = lm.Finder(sent[block, k]).places(pairs)
            assert sent[block, k][places].tolist() == pairs.tolist()
            want = [plain_leanings(counts.get(plain_contexts(t, i)[k], {}), byte) for t in mine for i, byte in enumerate(t + b"\0")]
            assert lean[places].tolist() == want
    assert lm.width_for(1 << 30) > lm.width_for(1 << 20) and lm.width_for(1 << 60) == lm.WIDEST


def test_refinement_adds_probabilities():
    mixed, counted, begin = np.log([0.5, 0.1, 0.2]), np.array([math.log(0.1), -1e4, math.log(0.4)]), np.array([0, 2, 3])
    first = math.log(0.5 * 0.5 + 0.5 * 0.1)
    weight = (lm.HABIT / 2 + 0.1 / 0.6) / (lm.HABIT + 1)
    assert lm.refined(mixed, counted, begin) == pytest.approx([first, math.log((1 - weight) * 0.1), math.log(0.3)])


def test_lm_of_repeated_rows_and_long_texts(spark):
    texts = [words(80, i, 90) for i in range(30)] + [words(60_000, 7, 5000), "a\0b c", None]
    docs = frame(spark, texts)
    once = {r.doc_id: r for r in lm.score(docs).collect()}
    rows = lm.score(docs.union(docs)).collect()
    assert len(rows) == 2 * len(texts) and all(r.n_tokens == once[r.doc_id].n_tokens and r.train_tokens == 2 * once[r.doc_id].train_tokens for r in rows)
    for r in once.values():
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / (len(lm.canonical((texts[r.doc_id] or "").encode())) + 1))


def test_kinds_of_text_are_inferred_from_the_words_before():
    counts = np.zeros((4, lm.KINDS_OF_TEXT))
    counts[:3, :2] = [[6, 1], [0, 3], [2, 2]]  # the fourth is unknown
    tokens = np.array([10.0, 30.0] + [0] * (lm.KINDS_OF_TEXT - 2))
    text = [0, 3, 2, 1]
    prior, want = [0.25, 0.75], []
    for w in text:
        whole = counts[w].sum() / 40
        each = [lm.OWN * counts[w][k] / tokens[k] + (1 - lm.OWN) * whole for k in (0, 1)]
        want.append(math.log(sum(a * b for a, b in zip(prior, each, strict=True)) / sum(prior)) if whole else -math.inf)
        prior = [a * b**lm.TRUST for a, b in zip(prior, each, strict=True)] if whole else prior
    got = lm.explained(counts[text + text], tokens, np.array([0, 4, 8]))
    assert got.tolist() == pytest.approx(want + want)


def test_lm_beats_its_base_on_held_out_texts(spark):
    r = lm.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > 0.97 * r.b


def test_language_of_held_out_and_mixed_texts(spark):
    make = lambda letters, n, seed: " ".join("".join(random.Random(seed * 999 + i).choices(letters, k=5)) for i in range(n))
    texts = [make("abcde", 40, i) if i % 2 else make("vwxyz", 40, i) for i in range(120)]
    langs = ["aa" if i % 2 else "zz" for i in range(120)]
    more = [None, "", "123 ... !", make("abcde", 60, 7) + " " + make("vwxyz", 20, 8)]
    rows = {r.doc_id: r for r in language.identify(frame(spark, texts + more, langs=[*langs, "aa", None, None, None])).collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(rows[i].lang_pred == langs[i] and rows[i].held_out for i in held)
    assert [rows[i].lang_pred for i in (120, 121, 122)] == ["und"] * 3 and rows[122].score == 0
    assert rows[123].lang_pred == "aa" and 0.6 < rows[123].score < 0.9
    assert language.identify(empty(spark)).count() == 0


# -- mixing


def test_mixing_meets_targets(spark):
    texts = [words(random.Random(i).randrange(1, 40), i) for i in range(600)] + [None, ""]
    sources = ["s%d" % (i % 3 if i % 2 else 0) for i in range(600)] + [None, "s1"]
    docs = frame(spark, texts, sources=sources)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 602
    by = collections.defaultdict(list)
    for r, s in zip(sorted(rows, key=lambda r: r.doc_id), sources, strict=True):
        by[s].append(r)
    for own in by.values():
        assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 40
    assert sum(own[0].target for own in by.values()) == pytest.approx(sum(r.size for r in rows))
    assert {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()} == {r.doc_id: r.taken for r in rows}
    whole = mixing.mixture(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r.taken // r.size for r in rows if r.size)
    assert mixing.mix(empty(spark)).count() == 0


def test_shares_stop_at_three_times_the_size(spark):
    totals = spark.createDataFrame([("a", 10), ("b", 500), ("c", 500), (None, 100)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(totals).collect()}
    assert got["a"] == 30 and got[None] == 300
    assert got["b"] / got["c"] == pytest.approx(2) and sum(got.values()) == pytest.approx(1110)


# -- urls


def test_urls(spark):
    cases = {
        "https://M.Example.COM/en/7123?x#y": ("m.example.com", "/en/7123", "example.com/en/7", "allow"), "http://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"), "ftp://a.example.net/de/8": ("a.example.net", "/de/8", "example.net/de/8", "block"),
        "http://x.org#/es/": ("x.org", "", None, "allow"), "no scheme/en/": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://b://c/en/": ("b:", "//c/en/", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "verdict") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "again")], "page_id long, url string, verdict string")
    rows = urls.judge(pages, RULES).collect()
    assert len(rows) == len(cases) + 1
    for r in rows:
        assert tuple(r)[1:] == list(cases.values())[r.page_id]
    assert urls.judge(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in urls.judge(pages, []).collect()} == {"allow"}


def test_rules_say_what_the_contract_says(spark):
    """Each rule's word, and on a url that no longer rule fits."""
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {r.text: r.verdict for r in RULES} == contract
    cases = ["http://x.com/en/", "http://example.com/en/7", "http://a.net/de/1", "http://example.net/de/8", "http://x.org/es/"]
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    assert {r.rule: r.verdict for r in urls.judge(pages, RULES).collect()} == contract


def test_cascade_is_exact_for_a_long_list(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("hash(key) % 9 = 0")
    levels = urls.build_cascade(universe, listed, listed.count())
    wrong = universe.join(listed.withColumn("in", F.lit(True)), "key", "left").where(F.coalesce("in", F.lit(False)) != urls.member(levels, F.col("key")))
    assert wrong.count() == 0 and len(levels) > 1


# -- repeats


def brute_repeats(texts):
    texts = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def repeating():
    passage, line = words(60, 99), words(45, 98)
    texts = [words(70, i) for i in range(30)]
    texts += [f"{words(30, 100 + i)} {passage} {words(30, 200 + i)}" for i in range(12)]
    texts += [(line + "\n") * 3, passage[:230], passage[7:206], "é" * 300 + passage, texts[3], texts[3], "x" * 700, "ab" * 300]
    return ODD + texts


@pytest.mark.parametrize("hot", [2, suffix.HOT])
def test_repeats_equal_brute_force(spark, hot):
    texts = repeating()
    rows = {r.doc_id: tuple(r)[1:] for r in suffix.remove_repeats(frame(spark, texts).repartition(3), hot=hot).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_repeats(texts)


def test_repeats_as_text_keep_columns_and_characters(spark):
    texts = repeating()
    docs = frame(spark, texts)
    rows = suffix.without_repeats(docs)
    assert rows.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in rows.collect())
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_suffix_order_is_the_sorted_one():
    dice = random.Random(1)
    data = bytes(dice.choice(b"ab") for _ in range(600)) + b"abcabc" * 60 + b"a" * 300
    data += data[:400]
    starts = np.array(sorted(dice.sample(range(len(data) - 200), 700)))
    order, same = suffix.sort_suffixes(np.frombuffer(data + b"\0" * 8, np.uint8), starts)
    got = [data[s : s + 200] for s in order.tolist()]
    assert got == sorted(data[s : s + 200] for s in starts.tolist())
    assert same.tolist() == [False] + [a == b for a, b in zip(got, got[1:], strict=False)]
    found = suffix.blind_trie(data, starts.tolist(), 0, 200)
    assert [data[s : s + 200] for s, _ in found] == got


def test_pieces_of_a_long_text_give_the_same_strings(monkeypatch):
    texts = [words(900, 4).encode(), words(40, 5).encode()]
    whole = [(int(t), int(f + o), int(e - f)) for _, text, _, _, first, last, off, _ in suffix._anchored(texts, 56) for t, f, e, o in zip(text, first, last, off, strict=True)]
    monkeypatch.setattr(suffix, "PIECE", 700)
    cut = [(int(t), int(f + o), int(e - f)) for _, text, _, _, first, last, off, _ in suffix._anchored(texts, 56) for t, f, e, o in zip(text, first, last, off, strict=True)]
    cover = lambda runs: sorted((t, s + i) for t, s, n in runs for i in range(n + 1))
    assert cover(whole) == cover(cut)


# -- near duplicates


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(sets)))
    changed = True
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return [(len(s), m, i == m) for i, (s, m) in enumerate(zip(sets, label, strict=True))]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    dice = random.Random(2)
    texts = [*ODD, *(words(90, i, 5000) for i in range(40))]
    for k in range(60):
        w = words(90, k % 5, 5000).split()
        for _ in range(dice.randrange(0, 7)):
            w[dice.randrange(90)] = f"edit{dice.randrange(999)}"
        texts.append(" ".join(w))
    texts += ["one", "Two  WORDS", texts[10], texts[10]]
    rows = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(frame(spark, texts).repartition(3), width=width, percent=percent).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_components(texts, width, percent)


def test_links_that_no_centre_finds_are_found(spark):
    dice = random.Random(1)
    texts = []
    for k in range(200):  # a family under the limit mostly: its buckets hold many components
        w = words(200, 1, 5000).split()
        for at in dice.sample(range(0, 200, 4), 4):
            w[at] = f"edit{k}x{at}"
        texts.append(" ".join(w))
    texts.append(texts[dice.randrange(200)] + " more")
    rows = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(frame(spark, texts), width=3, percent=85).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_components(texts, 3, 85)


def test_first_of_each_group_stays_once(spark):
    texts = [words(50, 1), words(50, 1), words(50, 2), None, "", words(50, 2)]
    docs = frame(spark, texts, [4, 3, 9, 10, None, 9])  # one row repeated
    kept = near.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 9), (False, 10), (True, 0)]
    assert near.near_duplicates(empty(spark)).count() == 0


def test_rows_that_share_an_id_go_only_with_their_group(spark):
    copy = words(50, 1) + " more"  # near the first text; its id is kept for another text
    texts = [words(50, 1), copy, words(50, 2), words(50, 3), words(50, 4), words(50, 4), words(50, 5), words(50, 6), words(50, 6), None, None]
    docs = frame(spark, texts, [1, 2, 2, None, None, None, 7, 7, 8, 9, 9])
    kept = near.first_of_each(docs)
    assert kept.columns == docs.columns
    want = [(1, texts[0]), (2, texts[2]), (7, texts[6]), (7, texts[7]), (9, None), (None, texts[3]), (None, texts[4])]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_densified_bins_are_alike_for_like_sets():
    a = np.sort(np.random.default_rng(1).integers(0, 2**63, 40).astype(np.uint64))
    sig = near.signatures([a, a[1:], np.sort(np.random.default_rng(2).integers(0, 2**63, 40).astype(np.uint64))], 160)
    assert (sig[0] == sig[1]).mean() > 0.85 and (sig[0] == sig[2]).mean() < 0.05


# -- audio


def test_media_round_trip(spark):
    rows = {r.doc_id: r for r in audio.media_columns(frame(spark, [*ODD, "one"]), digest=True).collect()}
    for i, t in enumerate([*ODD, "one"]):
        payload = audio.padded((t or "").encode())
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(payload)) and len(payload) % 576 == 0 and payload
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        media = audio.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and audio.load(media) == (7, 8000, payload)
    assert tuple(rows[3])[1:] == tuple(rows[len(ODD)])[1:]
    stored = audio.media_columns(frame(spark, ["abc"])).first()
    assert audio.load(stored.media)[2] == audio.padded(b"abc") and len(stored.pcm) == 4 * 576
    assert audio.media_columns(empty(spark)).count() == 0


def test_codecs_follow_their_rules():
    assert audio.MULAW[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0] and audio.ALAW[[0x55, 0xD5]].tolist() == [-8, 8]
    assert len(set(audio.ALAW.tolist())) == 256
    block = bytes([10, 0, 0, 0, 0x10, 0x8F]) + bytes(2)
    value, index, want = 10, 0, [10]
    for nibble in [n for b in block[4:] for n in (b & 15, b >> 4)]:
        step = int(audio.STEPS[index])
        d = (step >> 3) + (step >> 2 if nibble & 1 else 0) + (step >> 1 if nibble & 2 else 0) + (step if nibble & 4 else 0)
        value = max(-32768, min(32767, value - d if nibble & 8 else value + d))
        index = max(0, min(88, index + audio.INDEX_STEP[nibble & 7]))
        want.append(value)
    assert audio.decode_adpcm(np.frombuffer(block, np.uint8).reshape(1, -1))[0].tolist() == want


def test_word_runs_cut_at_white_space_only():
    text = words(5000, 3).encode()
    assert [w for run in word_runs(text, 100) for w in run] == text.split()
    assert list(word_runs(b"", 10)) == [[]]


# -- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs, out = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "mixing", "best_fit_packing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name == "best_fit_packing":
            break
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = out.collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


# -- repeated rows, shared ids, clashing names, huge numbers


def test_search_of_huge_components(spark):
    big = 2.0**70
    rows = [(0, [big, 1.0]), (1, [big, 1.0]), (2, [-big, 1.0]), (3, [1.0, 2.0]), (50, [1.0, -1.0]), (51, [1e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    end = 2**63 - 1
    held = [(i, r, j, min(max(s, -end), end)) for i, r, j, s in brute_topk([(i, [min(x, 2.0**1000) for x in v]) for i, v in rows], k=9)]
    want = []
    for q in (0, 50):
        own = sorted((-s, j) for i, _, j, s in held if i == q)[:5]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(own)]
    assert sorted(tuple(r) for r in topk.nearest(df).collect()) == want


def test_equal_rows_are_parted_by_the_mix(spark):
    texts = [words(9, 1)] * 300 + [words(9, 2)] * 100
    docs = frame(spark, texts, [None] * 300 + list(range(100)), sources=["a"] * 300 + ["b"] * 100)
    rows = mixing.mix(docs).collect()
    taken = sum(r.taken for r in rows if r.source_size == 2700)
    target = next(r.target for r in rows if r.source_size == 2700)
    assert abs(taken - target) <= 9
    assert mixing.mixture(docs).count() == sum(r.taken // r.size for r in rows)


CLASHES = "id long, row string, n int, rank int, hash long, bucket int, block long, comp string, node string, text string, doc_id long, lang string, source string, n_chars long, `near id` int"


def clashing(spark):
    texts = [words(50, 1), words(50, 1), words(50, 2), None, "", words(50, 2), words(260, 5), words(260, 5) + " tail", "short"]
    ids = [4, 3, 9, 10, None, 9, 20, 21, None]
    return spark.createDataFrame([(i, "r", i, i, i, i, i, "c", "n", t, k, "en", "s", len(t or ""), 0) for i, (t, k) in enumerate(zip(texts, ids, strict=True))], CLASHES)


def test_stages_take_tables_with_clashing_names(spark):
    docs = clashing(spark)
    labels = spark.createDataFrame([(4, 0), (9, 1)], "doc_id long, toxic int")
    assert toxicity.keep_ordinary(docs, labels).columns == docs.columns
    kept = near.first_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.id for r in kept.collect() if r.id != 5 and r.id != 2) == [1, 3, 4, 6, 8]
    assert suffix.without_repeats(docs).count() == 9 and mixing.mixture(docs).columns == docs.columns
    for f in (mixing.mix, suffix.remove_repeats, near.near_duplicates, language.identify, lm.score):
        assert f(docs).count() == 9
    assert toxicity.score(docs, labels).count() == 9 and audio.media_columns(docs, digest=True).count() == 9
    assert packing.pack(docs, tokenizer_path()).select("doc_id").distinct().count() == 7


def test_many_languages_in_one_text(spark):
    parts = ["abcde", "fghij", "klmno", "pqrst", "uvwxy"]
    make = lambda letters, n, seed: " ".join("".join(random.Random(seed * 999 + i).choices(letters, k=5)) for i in range(n))
    texts = [make(parts[i % 5], 60, i) for i in range(100)]
    model = language.fit(frame(spark, texts, langs=[parts[i % 5] for i in range(100)]))
    mixed = " ".join(make(p, n, 7 + n).strip() for p, n in zip(parts, (50, 40, 30, 20, 10), strict=True)).encode()
    best, share = language.infer([mixed, texts[1].encode(), b""], model)
    assert [model.languages[best[0]], model.languages[best[1]], best[2]] == ["abcde", "fghij", -1]
    assert abs(share[0] - 1 / 3) < 0.03 and share[1] > 0.99 and share[2] == 0


def test_lm_counts_beyond_32_bits():
    """Blocks' counts of a word add up to more than an unsigned 32-bit integer holds."""
    import numpy as np
    import pyarrow as pa

    from marginalia.llm import lm

    words, most = np.array([5, 9], np.uint64), 3_000_000_000
    counts = np.zeros((2, lm.KINDS_OF_TEXT), np.uint32)
    counts[0, 0], counts[1, 1] = most, 7
    rows = [(block, 0, words.tobytes(), lm._packed(counts)) for block in (1, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["block", "part", "slots", "counts"])
    (out,) = lm._meet([batch])
    assert np.sum(out.column("tokens").to_pylist(), 0).tolist() == [2 * most, 14, *[0] * (lm.KINDS_OF_TEXT - 2)]
    for back in out.column("counts").to_pylist():
        assert lm._unpacked(back, np.int64)[:, :2].tolist() == [[2 * most, 0], [0, 14]]


def test_near_duplicates_without_ids_meet_their_own_text_only(spark):
    """Near copies with null or shared ids: as many texts are made into sets as there are nodes, not their square."""
    import random

    from marginalia.llm import near

    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = [" ".join([*base[:i], f"own{i}", *base[i + 1 :]]) for i in range(60)]
    for ids in ([None] * 60, [7] * 60):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        seen = spark.sparkContext.accumulator(0)
        real = near._members

        def counted(it, width, real=real, seen=seen):
            for batch in it:
                seen.add(batch.num_rows)
                yield from real([batch], width)

        near._members = counted
        try:
            got = near.near_duplicates(docs, width=3, percent=85).collect()
        finally:
            near._members = real
        assert len(got) == 60
        assert len({r.component_id for r in got}) == 1
        assert seen.value == 60


def test_lm_leanings_travel_without_what_the_pair_before_says():
    import numpy as np

    from marginalia.llm import lm

    texts = [lm.canonical(b"%d the cat sat on mat %d and then the dog %d" % (i % 7, i * i % 911, i % 13)) for i in range(4000)] + [b"", b"\0 x"]
    train = np.arange(len(texts)) % 3 > 0
    known, places = lm.block_places(texts, 40)
    pairs = [np.concatenate(p) for p in zip(*(lm.Stream(texts[a:b]).pairs(40) for a, b in lm.groups(texts, lm.HASHED)), strict=True)]
    learned = np.repeat(train, [len(t) + 1 for t in texts])
    long = short = 0
    for own, at, all_pairs, (keys, counts) in zip(known, places, pairs, lm.block_pairs(texts, train, 40), strict=True):
        plain, which = np.unique(all_pairs, return_inverse=True)
        assert np.array_equal(keys, plain) and np.array_equal(counts, np.bincount(which[learned], minlength=len(plain)))
        found, of = own.ordered()
        assert np.array_equal(found, plain) and np.array_equal(of[at[:-1]], which + 1) and at[-1] == of[0] == 0
        lean = lm.leanings(keys, counts)
        assert np.array_equal(lm.unbrief(keys, lm.brief(keys, lean)), lean.view(np.uint64).ravel())
        long, short = long + len(lm.planes(lean)), short + len(lm.brief(keys, lean))
    assert short < 0.9 * long
    small = lm.Places(4)  # its slots change hands at once
    some = np.arange(1, 60, dtype=np.uint64) * np.uint64(977)
    again = [small.of(x) for x in (some, some[::-1].copy(), some)]
    keys, of = small.ordered()
    assert np.array_equal(keys, some) and all(np.array_equal(of[x], e) for x, e in zip(again, (np.arange(1, 60), np.arange(59, 0, -1), np.arange(1, 60)), strict=True))
    words = lm.vocabulary([b"a b a", b"", b"c"])
    assert words[1].tolist() == [0, 1, 0, 2] and words[2].tolist() == [3, 0, 1] and len(words[0]) == 3
    odd = ["", " ", " a  B\t\n c \x0b", "\x1c x\x85  \u00c9 y\u2003z", None, "a\0b \x1f c", "\u0130 I"]
    assert lm.canonicals(pa.array(odd, pa.string())) == [lm.canonical((x or "").encode()) for x in odd]


def test_packing_meets_words_in_parts_of_eight_megabytes():
    from marginalia.llm.common import chunks

    batch = pa.RecordBatch.from_arrays([pa.array(["seven words of a text of it " * 1000] * 250)], ["text"])  # 7 MB
    assert [x.num_rows for x in chunks([batch], "text", packing.PART)] == [250]


def test_lm_texts_stay_where_they_are(spark):
    """Blocks of texts are stored by the buckets that their leanings are dealt to, and not dealt again."""
    tables = {r.tableName for r in spark.sql("SHOW TABLES").collect()}
    scored = lm.score(frame(spark, ["a b", "c", None]).repartition(2))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1 and "SelectedBucketsCount: 64 out of 64" in plan
    assert scored.count() == 3 and {r.tableName for r in spark.sql("SHOW TABLES").collect()} == tables


def test_lm_distinct_words_are_looked_at_once():
    texts = [b"the cat", b"", b"a\0b the \x1f c", b"cat  the ", b"\xc3\xa9 a\x01"]
    train = np.array([True, True, False, True, False])
    once = lm.WordPlaces(lm.Tokens(texts), 40)
    many = lm.WordPlaces(lm.Tokens(texts * 50), 40)
    assert np.array_equal(once.places, many.places) and np.array_equal(once.keys, many.keys)
    for own, learn in ((texts, train), (texts[1:2], train[1:2]), ([], train[:0]), (texts * 50, np.tile(train, 50))):
        *_, plain = lm.Stream(own).pairs(40)
        *_, (keys, counts) = lm.block_pairs(own, learn, 40)
        known, places = lm.block_places(own, 40)
        names, which = np.unique(plain, return_inverse=True)
        learned = np.repeat(learn, [len(t) + 1 for t in own])
        assert np.array_equal(keys, names) and np.array_equal(counts, np.bincount(which[learned], minlength=len(names)))
        found, of = known[-1].ordered()
        assert np.array_equal(found, names) and np.array_equal(of[places[-1][:-1]], which + 1) and places[-1][-1] == 0


def test_lm_leanings_travel_without_what_the_bit_before_says():
    made = np.random.default_rng(5)
    contexts = np.sort(made.integers(0, 1 << 40, 4000).astype(np.uint64))
    keys = np.unique(np.concatenate([contexts[:n] << np.uint64(8) | made.integers(97, 123, n).astype(np.uint64) for n in (4000, 1000)]))
    lean = lm.leanings(keys, made.geometric(0.3, len(keys)))
    said, sign = lm._said(keys)
    one = lean * sign
    one[1:] -= one[:-1] * said[1:]
    assert len(lm.brief(keys, lean)) < 0.8 * len(lm.planes((one * sign).view(np.uint64).ravel()))  # as they travelled before
    wild = made.integers(-127, 128, lean.shape).astype(np.int8)
    wild[1:] = np.where(said[1:], 0, wild[1:])
    for k in range(1, len(keys)):  # what is said is the same node's
        wild[k] = np.where(said[k], wild[k - 1] * sign[k - 1] * sign[k], wild[k])
    for x in (lean, wild):
        assert np.array_equal(lm.unbrief(keys, lm.brief(keys, x)), np.ascontiguousarray(x).view(np.uint64).ravel())
    assert len(lm.unbrief(keys[:0], lm.brief(keys[:0], lean[:0]))) == 0


@pytest.mark.parametrize("most", [0, 3000, 10_000, 1 << 24])
def test_lm_last_bytes_are_found_by_chained_tables(monkeypatch, most):
    """A pair's place is that of the context one byte shorter and one byte more; tables that grow too large give way to hashes."""
    monkeypatch.setattr(lm.Chains, "MOST", most)
    monkeypatch.setattr(lm, "HASHED", 200)
    made = random.Random(3)
    texts = [bytes(made.choices(b"ab\0 \xc3\xa9xyz", k=made.randrange(60))) for _ in range(60)] + [b"", b"abab ab"]
    train = np.arange(len(texts)) % 3 > 0
    learned = np.repeat(train, [len(t) + 1 for t in texts])
    known, places = lm.block_places(texts, 40)
    for own, at, plain, (keys, counts) in zip(known, places, lm.Stream(texts).pairs(40), lm.block_pairs(texts, train, 40), strict=True):
        names, which = np.unique(plain, return_inverse=True)
        found, of = own.ordered()
        assert np.array_equal(found, names) and np.array_equal(of[at[:-1]], which + 1) and at[-1] == of[0] == 0
        assert np.array_equal(keys, names) and np.array_equal(counts, np.bincount(which[learned], minlength=len(names)))
    assert (known[0].more is None) == (most > 3000) and (known[1].more is None) == (most > 10_000)


def test_lm_kinds_are_summed_as_side_by_side():
    made = np.random.default_rng(2)
    counts, begin = made.integers(0, 9, (50, lm.KINDS_OF_TEXT)).astype(float), np.array([0, 0, 20, 20, 49, 50])
    counts[7] = 0
    tokens = counts.sum(axis=0)
    each, logs, known = lm.chances(counts, tokens)
    want = []
    for a, b in zip(begin, begin[1:], strict=False):
        for i in range(a, b):
            part = np.exp(logs[a:i].sum(axis=0)) * tokens
            want.append(np.log((part * each[i]).sum() / part.sum()) if known[i] else -np.inf)
    assert lm.inferred(each, logs, known, tokens, begin) == pytest.approx(want)
    assert len(lm.inferred(each[:0], logs[:0], known[:0], tokens, np.array([0, 0]))) == 0
