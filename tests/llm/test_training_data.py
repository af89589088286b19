"""Each operator against a brute-force version on small tables, with the odd cases of its docstring."""

import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ann, common, html_extract, mixing, ngram_join, packing, quality, sharding, suffix_dedup, toxicity
from palimpsest.llm.components import connected_components
from palimpsest.llm.embed_dedup import near_duplicates
from palimpsest.llm.suffix import common_prefixes, suffix_order

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0):
    """Documents with clashing extra columns."""
    rows = [(first + i, t, None if i % 3 == 0 else "en", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("x"), "sig": F.lit(1), "component": F.lit(2), "slot": F.lit(3)})


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and white texts, ties and repeated rows, one long text, other alphabets, null keys."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    d = documents(spark, [None, "", "  \n", "one two", "one two", "Ä é ß 中文 ñ", long, "x" * 5000, "İ Σς J̌ <|endoftext|>"])
    return d.unionByName(d.where("doc_id = 3")).unionByName(d.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))


def by_id(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


# Components


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 240)] + [(7, 7)]
    parent = {}
    root = lambda i: i if parent.setdefault(i, i) == i else root(parent[i])
    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: root(i) for i in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1. Packing


def whole_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def check_packing(rows, texts, size):
    want = {i: np.array(x, "<u4") for i, x in enumerate(whole_ids(texts))}
    seen, sequences = defaultdict(int), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[r["doc_id"]]
        assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(ids) and r["length"] > 0
        assert bytes(r["ids"]) == ids[r["start"] : r["start"] + r["length"]].tobytes()
        seen[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == {i: len(x) for i, x in want.items()}
    for s in sequences.values():
        assert sum(n for _, n in s) <= size
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
    return sequences


def test_packing_round_trip(spark):
    texts = [None, "", "Don't <|ENDOFTEXT|> stop", "Ä é ß 中文 ñ ² 12", "İ Σς J̌ <|endoftext|>", "x" * 3000, " ".join(f"Word{k}," for k in range(3000)), *[f"text number {k} " * (k % 40) for k in range(300)]]
    rows = packing.pack(documents(spark, texts).coalesce(1), size=256).collect()
    sequences = check_packing(rows, texts, 256)
    assert sum(sum(n for _, n in s) < 256 for s in sequences.values()) <= 1


def test_open_windows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_OPEN", 3)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    check_packing(packing.pack(documents(spark, texts).coalesce(1), size=64).collect(), texts, 64)


def test_sum_of_squares_takes_the_level_with_the_least_sum():
    rng = random.Random(1)
    pack = packing.SumOfSquares(50)
    for k in range(400):
        s = rng.randrange(1, 50)
        level, count = pack.level(s), pack.count.copy()

        def squares(h, count=count, s=s):
            c = count.copy()
            if h:
                c[h] -= 1
            if h + s < 50:
                c[h + s] += 1
            return (c * c).sum()

        options = [0, *(h for h in range(1, 51 - s) if count[h])]
        assert squares(level) == min(map(squares, options))
        pack.put((k, 0, b"1234" * s, s), s)
    assert sum(sum(len(p[2]) // 4 for p in w) < 50 for w in pack.drain()) <= 1


def test_packing_of_nothing_and_of_repeated_rows(spark, odd):
    assert packing.pack(odd.where("false")).count() == 0
    assert packing.pack(odd.where("doc_id = 3")).count() == 2


# 2. Vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"n_links": F.lit("x"), "id": F.lit(1)})


def brute_links(rows, least):
    ok = [(i, np.array(v, float), y) for i, (_, v, y) in enumerate(rows) if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for i, v, y in ok:
        for j, w, z in ok:
            if i != j and y == z and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= least:
                links[i].add(j)
    return links


def test_vector_links_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        base = rng.standard_normal(16) if k % 3 == 0 else np.array(rows[-1][1], float)
        rows.append((k, np.float32(base + (k % 3) * 0.05 * rng.standard_normal(16)).tolist(), int(k // 150)))
    near = rng.standard_normal(16)
    rows += [(1000 + k, np.float32(near + 0.02 * rng.standard_normal(16)).tolist(), 5) for k in range(60)]
    rows += [(2000 + k, [1.0, 2.0], 0) for k in range(5)] + [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [None] * 16, 1), (3004, [1.0] * 16, None), (3005, [], 1), (2001, [1.0, 2.0], 0)]
    links = brute_links([(None, v, y) for _, v, y in rows], 0.98)
    got = by_id(near_duplicates(vectors(spark, rows)), "vec_id")
    assert sum(map(len, got.values())) == len(rows)
    parent = list(range(len(rows)))
    root = lambda i: i if parent[i] == i else root(parent[i])
    for i in links:
        for j in links[i]:
            parent[root(j)] = root(i)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 1 << 60), r[0])
    for i, r in enumerate(rows):
        for g in got[r[0]]:
            assert (g["n_links"], g["component_id"]) == (len(links[i]), least[root(i)]), r
            assert g["kept"] == (r[0] == least[root(i)])


def test_large_buckets_go_in_blocks(spark, monkeypatch):
    from palimpsest.llm import embed_dedup

    monkeypatch.setattr(embed_dedup, "BLOCK", 10)
    rng = np.random.default_rng(5)
    near = rng.standard_normal(8)
    rows = [(k, np.float32(near + 0.01 * rng.standard_normal(8)).tolist(), 1) for k in range(50)]
    links = brute_links(rows, 0.98)
    assert {r["vec_id"]: r["n_links"] for r in near_duplicates(vectors(spark, rows)).collect()} == {i: len(links[i]) for i in range(50)}


def test_no_vectors(spark):
    assert near_duplicates(vectors(spark, [(1, [1.0], 1)]).where("false")).count() == 0


# 3. N-gram join


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(ids, sets):
    parent = list(range(len(ids)))
    root = lambda i: i if parent[i] == i else root(parent[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), x), x)
    return [least[root(i)] for i in range(len(ids))]


def near_texts(rng, n):
    texts = []
    for k in range(n):
        if k % 4 == 0 or not texts:
            w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 80))]
        else:
            w = texts[-1].split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"W{rng.randrange(300)}"
        texts.append(" ".join(w))
    return texts


def test_similar_texts_against_all_pairs(spark):
    rng = random.Random(7)
    base = [f"b{k}" for k in range(60)]
    texts = [*near_texts(rng, 160), None, "", " \t\n", "a b", "A  b", "a b c", *near_texts(rng, 8)]
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = f"e{rng.randrange(1000)}"
        texts.append(" ".join(w))
    sets = brute_sets(texts)
    want = brute_components(range(len(texts)), sets)
    got = by_id(ngram_join.similar_texts(documents(spark, texts)))
    assert [(got[i][0]["n_shingles"], got[i][0]["component_id"]) for i in range(len(texts))] == list(zip(map(len, sets), want, strict=True))


def test_hot_tokens_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TOKEN_BLOCK", 3)
    monkeypatch.setattr(ngram_join, "KEYS", 0)
    rng = random.Random(12)
    base, texts = [f"b{k}" for k in range(40)], []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(40)] = f"e{rng.randrange(30)}"
        texts.append(" ".join(w))
    want = brute_components(range(len(texts)), brute_sets(texts))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_texts(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_divide_skip_finds_all_members_with_enough_occurrences():
    rng = random.Random(2)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randrange(1, 30))) for _ in range(rng.randrange(1, 12))]
        count = Counter(x for y in lists for x in y)
        for least in range(1, len(lists) + 1):
            assert dict(ngram_join.divide_skip(lists, least)) == {x: c for x, c in count.items() if c >= least}


def test_similar_texts_on_odd_rows(spark, odd):
    got = by_id(ngram_join.similar_texts(odd))
    assert len(got[3]) == 2 and got[4][0]["component_id"] == 3
    assert got[0][0]["n_shingles"] == 0 and got[None][0]["component_id"] is None
    assert ngram_join.similar_texts(odd.where("false")).count() == 0
    clash = ngram_join.one_of_each(odd.withColumns({"_same": F.lit("a"), "_kept": F.lit("b"), "_key": F.lit("c")}))
    assert {(r["_same"], r["_kept"], r["_key"]) for r in clash.collect()} == {("a", "b", "c")}
    kept = by_id(ngram_join.one_of_each(odd))
    assert 4 not in kept and len(kept[3]) == 1 and len(kept[None]) == 1 and {0, 1, 2, 6} <= set(kept)


# 4. Sharding


def test_sharding_counts_slots_and_moves(spark, odd):
    d = documents(spark, [f"t{k}" for k in range(2000)])
    rows = sharding.shard(d, [1.0] * 24).collect()
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
        assert r["size"] == len(f"t{r['doc_id']}") + 8 and r["text_crc32"] == zlib.crc32(f"t{r['doc_id']}".encode())
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and len(by_shard) == 24
    assert 40 < sum(r["grown_shard"] == 24 for r in rows) < 130
    heavy = sharding.shard(d, [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 2000 for r in heavy}
    assert set(share) == {0, 1} and abs(share[1] - 0.75) < 0.05
    got = by_id(sharding.shard(odd, [1.0] * 24))
    assert got[0][0]["size"] == 8 and got[0][0]["text_crc32"] == 0 and len({r["slot"] for r in got[3]}) == 2
    assert sharding.shard(odd.where("false"), [1.0]).count() == 0


def plain_rendezvous(key, weights):
    def score(k):
        u = (int(hashlib.md5(f"{key}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return -math.log(u) / weights[k]

    return min((k for k in range(len(weights)) if weights[k] > 0), key=lambda k: (score(k), k))


def test_shards_against_a_plain_rendezvous(spark):
    weights = [1.0] * 10 + [2.5, 0.0] + [0.5] * 12
    for r in sharding.shard(documents(spark, [f"t{k}" for k in range(400)]), weights).collect():
        assert (r["shard"], r["grown_shard"]) == (plain_rendezvous(r["doc_id"], weights), plain_rendezvous(r["doc_id"], [*weights, 1.0]))


# 5 and 7. Classifiers


def test_indicators_and_ratios_against_plain_ones():
    texts = [b"Good words, here and there.", b"bad bad bad bad!! bad", b"", b"x", b"One two one two THREE\n"]
    bounds = np.cumsum([0, *map(len, texts)])
    rows = quality.indicators(np.frombuffer(b"".join(texts), np.uint8), bounds)
    for text, row in zip(texts, rows, strict=True):
        shape = [int(quality._SHAPE[b]) for b in text]
        want = {sum(shape[i + j] << 5 * j for j in range(3)) for i in range(len(shape) - 2)}
        assert {int(x) for x in row if x < quality.WIDTH} == want
        words = text.lower().split()
        again = [a == b for a, b in zip(words, words[1:], strict=False)]
        share = [int(x) - 2 * quality.WIDTH - len(quality.REPEATS) for x in row if x >= 2 * quality.WIDTH + len(quality.REPEATS)]
        assert share == ([int(10 * np.mean(again))] if again else [])
    good = np.array([True, False, True, False, True])
    ratio = quality.log_count_ratios(rows, good)
    count = lambda f, side: sum(f in set(r.tolist()) for r, g in zip(rows, good, strict=True) if g == side) + 1.0
    total = [sum(len(r) for r, g in zip(rows, good, strict=True) if g == side) + quality.SIZE for side in (True, False)]
    for f in {int(x) for r in rows for x in r}:
        assert abs(ratio[f] - math.log(count(f, True) / total[0] / (count(f, False) / total[1]))) < 1e-9


def test_quality_on_held_out_rows(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(d, y).join(y, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 8)) if k % 2 else np.unique(rng.integers(30, 80, 8)) for k in range(200)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(200)])
    w = quality.dual_descent(rows, y, np.ones(80))
    assert np.mean([(w[r].sum() / np.sqrt(len(r)) + w[-1] > 0) == (t > 0) for r, t in zip(rows, y, strict=True)]) > 0.95


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_scores_of_odd_rows_and_without_labels(spark, odd, score):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score(odd, none).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert score(odd.where("false"), none).count() == 0


def test_toxicity_on_held_out_rows(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    labelled = d.join(y.select("doc_id"), "doc_id")
    got = toxicity.score_toxicity(labelled, y).join(y, "doc_id").where("held_out").collect()
    both = sum(r["predicted"] and r["toxic"] for r in got)
    assert both / sum(r["predicted"] for r in got) > 0.9 and both / sum(r["toxic"] for r in got) > 0.9


def every_reading(span):
    """All readings of a span's lattice: (letters and word ends, cost of the channel)."""
    t, out = toxicity, []

    def go(i, said, last, cost):
        if i == len(span):
            out.append(("".join(said), cost))
            return
        ch = span[i]
        stands = t.STANDS_FOR.get(ch)
        if ch.isalpha():
            go(i + 1, [*said, ch], ch, cost)
            if ch == last:
                go(i + 1, said, last, cost + t.COST_REPEAT)
        elif stands is None:
            go(i + 1, [*said, ch], "", cost + t.COST_KEPT)
        else:
            for x in stands:
                go(i + 1, [*said, x], x, cost + t.COST_STAND_IN)
                if x == last:
                    go(i + 1, said, last, cost + t.COST_REPEAT + t.COST_STAND_IN)
            go(i + 1, said, last, cost + (t.COST_KEPT if stands else t.COST_SEPARATOR))
            if ch in t.PUNCTUATION or not stands:
                ended = cost + (t.COST_PUNCTUATION if stands else t.COST_BOUNDARY)
                go(i + 1, [*said, " "] if said and said[-1] != " " else said, "", ended)

    go(0, [], "", 0.0)
    return out


def test_viterbi_finds_the_cheapest_reading():
    rng = random.Random(4)
    model = toxicity.letter_model(np.array([rng.random() ** 6 * 100 for _ in range(28**3)]))
    for _ in range(150):
        span = "".join(rng.choice("abcoo1!$0.- ") for _ in range(rng.randrange(1, 8)))

        def cost(said):
            c = [0, 0, *(ord(x) - 96 if "a" <= x <= "z" else 0 for x in said)]
            c += [0] if c[-1] or True else []
            return sum(model[c[k] * 28 + c[k + 1]][c[k + 2]] for k in range(len(c) - 2))

        best = min(channel + cost(said) for said, channel in every_reading(span))
        got = toxicity.restore(span, model)
        assert any(abs(channel + cost(said) - best) < 1e-6 for said, channel in every_reading(span) if said == got), span


def test_toxicity_restores_disguised_words(spark):
    rng = random.Random(1)
    plain = ["river", "stone", "window", "garden", "letter", "orange", "silver", "simple", "mother", "winter", "summer", "market"]
    texts, toxic = [], []
    for k in range(400):
        w = [rng.choice(plain) for _ in range(30)]
        if k % 4 == 0:
            w[rng.randrange(30)] = rng.choice(["idiot", "moron", "worthless"])
        texts.append(" ".join(w))
        toxic.append(int(k % 4 == 0))
    hidden = ["river 1d10t stone", "garden i d i o t river", "silver w0rthle$$ orange", "letter moooron simple", "river idiiot stone", "garden Moroon letter"]
    d = documents(spark, [*texts, *hidden, "river stone garden", None])
    y = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(d, y).collect()}
    assert [got[i] for i in range(400)] == toxic
    assert [got[400 + i] for i in range(8)] == [1, 1, 1, 1, 1, 1, 0, 0]
    kept = toxicity.reject_toxic(d.withColumn("_toxicity", F.lit("mine")), y)
    assert kept.count() == 302 and kept.columns == [*d.columns, "_toxicity"] and {r["_toxicity"] for r in kept.collect()} == {"mine"}


def test_every_mix_of_disguises_is_restored():
    words = ["river", "stone", "window", "garden", "what", "a", "the", "is", "he", "kill", "killer", "idiot", "stupid", "die", "moron", "ass", "steal", "letter", "worthless"]
    rng = random.Random(2)
    c = toxicity._CLASS[np.frombuffer(" ".join(rng.choice(words) for _ in range(20_000)).encode(), np.uint8)]
    model = toxicity.letter_model(np.bincount(c[:-2] * 784 + c[1:-1] * 28 + c[2:], minlength=28**3).astype(float))
    hidden = {
        "k 1 l l": "kill", "1 d 1 o t": "idiot", "i.d.1.o.t": "idiot", "d i e": "die", "k - i - l - l": "kill", "k  i  l  l": "kill", "id.iot": "idiot", "stu-pid": "stupid", "a$$": "ass", "$teal": "steal",
        "st€al": "steal", "£etter": "letter", "mOoOron": "moron", "1diot!": "idiot", "(id.iot": "idiot", "what a k i l l": "what a kill", "the.1diot": "the idiot", "w0rthle$$": "worthless",
    }
    for raw, word in hidden.items():
        for text in (f"river {raw} stone", raw, f"river, {raw}."):
            assert word.split()[-1] in toxicity.restored(text, model, {}).lower().split(), text
    for raw in ("id\u200biot", "i\u200bd\u200biot", "\u00adid\u00adiot", "stu\ufeffpid"):
        assert toxicity.restored(f"river {raw} stone", model, {}).lower().split()[-1] in ("idiot", "stupid"), raw
    far = toxicity.restored("1diot" + "." * 3 + "x" * 60, model, {}).lower().split()
    assert any(w.startswith("idiot") for w in far)
    for plain in ("river stone", "1995-02-03", "the river. Stone", "letter - 12.5"):
        assert toxicity.restored(plain, model, {}) == ""


# 6. Nearest neighbours


def test_search_recall_ranks_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    x = np.float32(rng.standard_normal((600, 24)))
    rows = [(k, x[k].tolist(), 1) for k in range(600)] + [(700 + k, x[0].tolist(), 1) for k in range(9)] + [(900, None, 1), (950, [0.0] * 24, 1), (1000, [float("inf")] * 24, 1), (1050, [1.0], 1)]
    got = by_id(ann.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0), "query_id")
    assert set(got) == {*range(0, 600, 50), 700}
    hit = 0
    ok = [(i, np.array(v, float)) for i, v, _ in rows if v and len(v) == 24 and all(np.isfinite(v)) and any(v)]
    for q, found in got.items():
        v = dict(ok)[q]
        best = sorted((-(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), i) for i, w in ok if i != q)[:5]
        found = sorted(found, key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and all(a["score"] >= b["score"] for a, b in zip(found, found[1:], strict=False))
        hit += len({r["vec_id"] for r in found} & {i for _, i in best})
    assert hit / (5 * len(got)) >= 0.9
    assert [r["vec_id"] for r in sorted(got[0], key=lambda r: r["rank"])] == [700, 701, 702, 703, 704]
    few = ann.nearest(vectors(spark, rows[:3]), F.col("vec_id") == 0).collect()
    assert {r["vec_id"] for r in few} == {1, 2}
    assert ann.nearest(vectors(spark, rows[:1]).where("false"), F.col("vec_id") == 0).count() == 0


def test_equal_vectors_of_repeated_rows_count_by_key(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, [float(v) for v in rng.standard_normal(8)]) for i in range(50)] + [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for i in range(50, 57)]
    d = spark.createDataFrame(vectors + vectors, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in ann.nearest(d, F.col("vec_id") == 50).orderBy("rank").collect()]
    assert got == [(1, 51), (2, 52), (3, 53), (4, 54), (5, 55)]


def test_probing_finds_every_code_within_the_radius():
    code = np.random.default_rng(1).integers(0, 256, (500, 8)).astype(np.uint8)
    index = ann.Index(code)
    for radius in (0, 5, 13, 20, 27):
        for q in code[:20]:
            want = np.flatnonzero(np.unpackbits(code ^ q, axis=1).sum(axis=1) <= radius)
            assert index.within(q, radius).tolist() == want.tolist()


# 8. Repeats


def brute_removed(texts, length):
    texts = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        cover = np.cumsum(mark)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], cover])) == 1).sum())
        out.append((len(t), int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~cover])).hexdigest()))
    return out


def brute_passages(texts, length, words):
    texts = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 2, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mark[i + 1] += 1
                mark[i + 1 + length] -= 1
        edge = np.flatnonzero(np.diff((np.cumsum(mark) > 0).astype(int)))
        out.append(sum(e - b for b, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if len(t[b:e].split()) >= words))
    return out


@pytest.mark.parametrize("most", [256, 3])
def test_repeats_against_all_windows(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    rng = random.Random(most)
    say = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [say(rng.randrange(30, 200)) for _ in range(6)]
    texts = [say(rng.randrange(200)) + "".join(rng.choice(shared) + say(rng.randrange(60)) for _ in range(rng.randrange(3))) for _ in range(60)]
    texts += [None, "", "short", "abc" * 80, "zabc" * 3, texts[0], texts[0], say(300) * 2, *(say(50) + shared[0] + say(50) for _ in range(20))]
    got = by_id(suffix_dedup.repeat_digests(documents(spark, texts), length=40, passage=25, words=3))
    assert [tuple(got[i][0][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))] == brute_removed(texts, 40)
    assert [got[i][0]["n_passage"] for i in range(len(texts))] == brute_passages(texts, 25, 3)


def test_repeats_keep_rows_and_columns(spark, odd):
    out = suffix_dedup.remove_repeats(odd)
    assert out.columns == [*odd.columns, "spans"] and out.count() == odd.count()
    got = by_id(out)
    assert got[0][0]["text"] is None and got[3][0]["text"] == "one two" and got[7][0]["text"] == "" and got[7][0]["spans"][0]["end"] == 5000
    twice = documents(spark, ["x" * 500, "other text " * 50]).where("doc_id = 0")
    got = suffix_dedup.repeat_digests(twice.unionByName(twice)).collect()
    assert [(r["n_removed"], r["n_spans"]) for r in got] == [(500, 1), (500, 1)]
    passage = " ".join(f"p{k % 7}q{k}" for k in range(60))
    got = by_id(suffix_dedup.remove_repeats(documents(spark, [f"alpha {passage} two", f"third {passage} four"]), length=220, words=50))
    assert [got[i][0]["text"] for i in (0, 1)] == ["alphatwo", "thirdfour"]
    got = by_id(suffix_dedup.remove_repeats(documents(spark, [f"alpha {passage} two", f"third {passage} four"]), length=220, words=80))
    assert got[0][0]["text"] == f"alpha {passage} two" and got[0][0]["spans"] is None
    assert suffix_dedup.remove_repeats(odd.where("false")).count() == 0
    assert suffix_dedup.repeat_digests(odd.where("false")).count() == 0


def test_suffix_order_and_prefixes():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randrange(rng.choice([1, 2, 4, 9])) for _ in range(rng.randrange(40))]
        order = suffix_order(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        for k, n in enumerate(common_prefixes(s, order)[1:], 1):
            a, b = s[order[k - 1] :], s[order[k] :]
            assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


# 9. Pages

PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<div id="cookie-notice"><p>We use cookies. Please accept them all to go on.</p></div><header><h1>Site</h1><nav><a href=/>Home</a> <a href=/n>News</a></nav></header>
<div class="sidebar"><p>Related stories, one and two. And three.</p></div><article><h1>Real &amp; true</h1><p>First   paragraph,\n with <b>bold &lt;text&gt;</b> and <a href=x>a link</a>. It goes on.
<p>Second&nbsp;one.<br>More of it.</p><div class="ad">Buy now! Great offers.</div><p>Short.</p></article><section class="comments"><p>I liked it, said a reader. A lot.</p></section>
<form><p>Sign up here. Enter your address.</p></form><footer>&copy; Somebody. All rights reserved.</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<article><p>cut of"), (1, "u", PAGE), (None, "u", "<nav>menu</nav>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = by_id(html_extract.extract_main_text(d), "page_id")
    assert got[1][0]["text"] == "Real & true\nFirst paragraph, with bold <text> and a link. It goes on.\nSecond one. More of it.\nShort."
    assert got[1][0]["n_chars"] == len(got[1][0]["text"]) and len(got[1]) == 2
    assert (got[2][0]["text"], got[3][0]["text"], got[4][0]["text"], got[None][0]["text"]) == ("", "", "cut of", "")
    assert html_extract.extract_main_text(d.where("false")).count() == 0


def plain_article(page):
    """The blocks of the page's <article>, by plain splitting at block tags; adverts, forms and the like inside it go."""
    m = re.search(r"(?is)<article\b[^>]*>(.*?)</article>", page)
    body = re.sub(r"(?is)<!--.*?-->|<(script|style|form|aside|nav)\b.*?</\1>|<(\w+)[^>]*class=\"(?:ad|advert|share|newsletter|related|comments?)\b[^\"]*\"[^>]*>.*?</\2>", " ", m[1])
    parts = re.split(r"(?i)</?(?:p|h[1-6]|div|ul|ol|li|blockquote|section|table|tr|td|th|pre|figure|figcaption)\b[^>]*>", body)
    texts = [" ".join(html.unescape(re.sub(r"(?i)<br\b[^>]*>", " ", x) if "<" not in x else re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br\b[^>]*>", " ", x))).split()) for x in parts]
    return "\n".join(t for t in texts if t)


def test_pages_are_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages).collect()}
    want = {r["page_id"]: plain_article(r["html"]) for r in pages.collect() if r["html"] and re.search("(?i)<article", r["html"])}
    assert len(want) > 100 and sum(got[i] == t for i, t in want.items()) / len(want) > 0.97


def test_open_heads_and_controls_end_with_the_first_block():
    said = "The article has sentences. They are long enough to be kept, and they end with stops."
    for page in (
        f"<html><head><title>T</title><meta charset=utf-8><body><article><p>{said}</p></article></body></html>",
        f"<head><title>T</title><noscript><style>x</style></noscript><p>{said}</p>",
        f"<html><head><link href=x><article>{said}</article>",
        f"<html><head></head><body><select><option>one<option>two<article><p>{said}</p></article></body></html>",
        f"<html><body><button>Press<article><p>{said}</p></article></body></html>",
        f"<html><head><title>T</title>{said}",
    ):
        assert html_extract.main_text(page) == said, page
    assert "hidden" not in html_extract.main_text(f"<head><noscript><p>hidden</p></noscript></head><body><select><option>hidden<hr><option>hidden</select><button><div>hidden</div></button><p>{said}</p>")


@pytest.mark.parametrize(
    ("part", "times", "end"),
    [("<div>x", 160_000, ""), ('<a "', 250_000, ""), ("<b>", 150_000, "<p>x" * 100_000), ("<button><div>x", 70_000, "</button>"), ("<ul><li>one. two", 60_000, ""), ("<p>Some words. Here.</p>", 40_000, ""), ("<a x", 250_000, ">"), ("<!-- ", 200_000, "")],
)
def test_long_broken_pages_take_linear_time(part, times, end):
    began = time.process_time()
    html_extract.main_text(part * times + end)
    assert time.process_time() - began < 15


def test_unclosed_quotes_leave_the_text():
    said = "The article has sentences. They are long enough to be kept, and they end with stops."
    assert html_extract.main_text(f'<article><p>{said} <a "b</p><p>{said}</p>') == f'{said} <a "b\n{said}'
    assert html_extract.main_text(f"<article><p title='a > b'>{said}</p>") == said


@pytest.mark.parametrize("opens", ['<article class="research">', '<article class="post metadata-rich">', '<div class="social-content">', '<main id="searchlight-story">', '<section class="headers-of-state content">', '<div class="navy entry">', '<div id="pageContent">', '<article class="Header-free">'])
def test_names_count_by_whole_parts(opens):
    said = [f"The {k}th sentence of it says something that a reader wants to know. It goes on, and it ends here." for k in range(6)]
    end = f"</{opens[1:].split()[0]}>"
    want = "\n".join(said)
    body = "".join(f"<p>{x}</p>" for x in said)
    assert html_extract.main_text(f"<body><nav><a href=/>Home</a></nav>{opens}{body}{end}<footer>All rights reserved.</footer></body>") == want


@pytest.mark.parametrize("name", ["sidebar", "side-bar", "site_footer", "topNav", "comment-list", "post-meta", "related-posts", "ad", "ad-slot", "share buttons", "cookieNotice", "content-sidebar", "sign-up box"])
def test_names_against_content(name):
    said = "This sentence stands in a box beside the article. It is long enough, and it has some stops."
    assert html_extract.main_text(f'<body><article><p>{said} It is the article.</p></article><div class="{name}"><p>{said}</p></div></body>') == f"{said} It is the article."


def test_lists_of_links_inside_an_article_stay():
    said = "The sentence before the list says what is in it. It has a second one, too."
    links = "".join(f"<li><a href=/{k}>The {k}th work that is listed</a></li>" for k in range(5))
    got = html_extract.main_text(f"<body><nav><ul>{links}</ul></nav><article><p>{said}</p><ul>{links}</ul><p>{said}</p></article></body>")
    assert got == "\n".join([said, *(f"The {k}th work that is listed" for k in range(5)), said])


def test_minimum_cut_is_the_best_labelling():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(1, 8)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randrange(8))]
        cost = lambda side, gain=gain, edges=edges: sum(abs(g) for g, s in zip(gain, side, strict=True) if (g > 0) != s) + sum(c for u, v, c in edges if side[u] != side[v])
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.source_side(gain, edges)) - best) < 1e-6


# 10. Mixing


def test_pfair_deviates_by_less_than_one_block_from_the_weights():
    rng = random.Random(3)
    named = {f"src{k}": x for k, x in enumerate([8.0, 3.0, 2.0, *[1.0] * 17])}
    cases = [named, {"a": 0.1, "b": 0.25, None: 1 / 3}, {"a": 7}, *({f"s{k}": rng.choice([1, 5, 30]) * rng.randrange(1, 50) / 100 for k in range(rng.randrange(1, 25))} for _ in range(10))]
    for w in cases:
        exact = {s: Fraction(round(Fraction(x) * 10**6)) for s, x in w.items()}
        share = {s: x / sum(exact.values()) for s, x in exact.items()}
        count = mixing.whole_weights(w)
        assert {s: Fraction(c, sum(count.values())) for s, c in count.items()} == share
        if sum(count.values()) > 20_000:
            continue
        period, had = mixing.pfair(count), Counter()
        assert [x[4] for x in period] == list(range(sum(count.values())))
        for s, _, release, deadline, t in period:
            assert release <= t < deadline
            had[s] += 1
            assert all(abs(had[x] - (t + 1) * c) < 1 for x, c in share.items())
        assert had == count  # so the next period begins as this one did


def test_a_million_slots_keep_to_the_targets():
    w = {f"src{k}": {0: 8.0, 1: 3.0, 2: 2.0}.get(k, 1.0) for k in range(20)}
    total, had, worst = sum(w.values()), Counter(), 0
    order = [x[0] for x in mixing.pfair(mixing.whole_weights(w))]
    for t in range(1_000_000):
        s = order[t % len(order)]
        had[s] += 1
        worst = max(worst, abs(had[s] - (t + 1) * w[s] / total))
    assert worst < 1 and all(abs(had[s] - 10**6 * x / total) < 1 for s, x in w.items())


def test_odd_weights(spark):
    assert mixing.whole_weights({"a": 0.0, "b": 2.5, "c": 5.0}) == {"b": 1, "c": 2}
    assert mixing.whole_weights({}) == {}
    for bad in ({"a": -1.0}, {"a": float("nan")}, {"a": float("inf")}, {"a": 0.123457, "b": 987.654321}):
        with pytest.raises(ValueError):
            mixing.whole_weights(bad)
    rows = [(i, f"s{i % 3}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, source string")
    got = sorted(mixing.mix(d, {"s1": 2.0}, block=3).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(60)) and {r["source"] for r in got[:20]} == {"s1"}
    assert Counter(r["source"] for r in got[20:26]) == {"s0": 3, "s2": 3}


def plain_mix(rows, weights, other, block):
    """Each row's (block, release, deadline, slot) and place, by a schedule that goes slot by slot and never ends a period."""
    by_source = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        by_source[r["source"]].append(r["doc_id"])
    weight = {s: Fraction(round(Fraction(weights.get(s, other)) * 10**6)) for s in by_source}
    total = sum(weight.values())
    done, out = Counter(), {}
    t = place = 0
    while any(done[s] * block < len(ids) for s, ids in by_source.items()):
        # Of the blocks released by now, that with the earliest deadline; ties as documented.
        due = {s: (done[s] + 1) * total / w for s, w in weight.items()}
        ready = [(math.ceil(due[s]), due[s].denominator == 1, -w, s is None, s or "") for s, w in weight.items() if math.floor(done[s] * total / w) <= t]
        last, _, _, none, s = min(ready)
        s = None if none else s
        b = done[s]
        for i in by_source[s][b * block : (b + 1) * block]:
            out[i] = (b, math.floor(b * total / weight[s]), last, t, place)
            place += 1
        done[s] += 1
        t += 1
    return out


def test_mixing_against_a_plain_schedule(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["s1", "s1", "s1", "s2", "s3", None]), "x", 1, 2, 3, 4) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, source string, _tie string, _n int, _c int, _slot int, _row int")
    weights = {"s1": 5.0, "s2": 1.5}
    got = {r["doc_id"]: tuple(r[c] for c in ("block", "release", "deadline", "slot", "position")) for r in mixing.mix(d, weights, block=2, other=0.7).collect()}
    want = plain_mix([{"doc_id": r[0], "source": r[1]} for r in rows], weights, 0.7, 2)
    source = {r[0]: r[1] for r in rows}
    # A source's rows come in an order of their own; which of them has a place is free, the places are not.
    assert Counter((source[i], *x) for i, x in got.items()) == Counter((source[i], *x) for i, x in want.items())
    ordered = mixing.mixed_order(d, weights, block=2, other=0.7)
    assert ordered.columns == d.columns and [r["doc_id"] for r in ordered.collect()] == sorted(got, key=lambda i: got[i][4])
    assert {r["_tie"] for r in ordered.collect()} == {"x"}


def test_positions_of_more_slots_than_two_levels_hold(spark, monkeypatch):
    """Running sums add a level at every STEP-fold of the slots; the third came at 65,536."""
    sparse = spark.range(70_000).select((F.col("id") * 2 + 1).alias("slot"), (F.col("id") % 3).alias("rows"))
    got = common.running(sparse, "slot", "rows", "start")
    assert got.columns == ["slot", "start"] and got.count() == 70_000
    k = F.floor(F.col("slot") / 2)
    assert not got.where(F.col("start") != F.floor(k / 3) * 3 + F.when(k % 3 == 2, 1).otherwise(0)).take(1)

    monkeypatch.setattr(common, "STEP", 3)
    rows = [(i, f"s{i % 7 % 3}") for i in range(400)]
    weights = {"s0": 3.0, "s1": 2.0}
    got = {r["doc_id"]: tuple(r[c] for c in ("block", "release", "deadline", "slot", "position")) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=2, other=1.0).collect()}
    want = plain_mix([{"doc_id": r[0], "source": r[1]} for r in rows], weights, 1.0, 2)
    source = dict(rows)
    assert max(x[3] for x in got.values()) > 3**4
    assert Counter((source[i], *x) for i, x in got.items()) == Counter((source[i], *x) for i, x in want.items())


def test_mixing_places_every_row_once(spark, odd):
    d = documents(spark, [f"t{k}" for k in range(700)])
    rows = mixing.mix(d, {"s1": 3.0, "s2": 1.0}, block=4).collect()
    assert sorted(r["position"] for r in rows) == list(range(700))
    assert all(n <= 4 for n in Counter((r["source"], r["block"]) for r in rows).values())
    order = sorted(rows, key=lambda r: r["position"])
    assert [r["slot"] for r in order] == sorted(r["slot"] for r in rows)
    early = Counter(r["source"] for r in order[:120])
    assert 2.5 < early["s1"] / early["s2"] < 3.6
    got = by_id(mixing.mix(odd))
    assert len(got[3]) == 2 and sum(map(len, got.values())) == odd.count()
    assert mixing.mix(odd.where("false")).count() == 0
    assert mixing.mixed_order(odd).columns == odd.columns
