"""Seating of the language model against exact values."""

import math
import random

import numpy as np
import pytest

from quillspark.llm import hpylm, seating


def stirling(n, discount):
    rows = [{0: 1.0}]
    for c in range(n):
        rows.append({t: rows[c].get(t - 1, 0.0) + (c - discount * t) * rows[c].get(t, 0.0) for t in range(1, c + 2)})
    return rows


@pytest.mark.parametrize("discount", [0.1, 0.5, 0.9])
def test_stirling_numbers(discount):
    exact = stirling(20, discount)
    for c in range(1, 21):
        got = seating.log_stirling(np.full(c, c), np.arange(1, c + 1), discount)
        assert got == pytest.approx([math.log(exact[c][t]) for t in range(1, c + 1)], abs=1e-9)
    assert seating.log_stirling(np.array([3, 300]), np.array([4, 301]), discount).tolist() == [-math.inf] * 2


@pytest.mark.parametrize("discount", [0.05, 0.3, 0.7, 0.95])
def test_large_stirling_numbers_follow_their_recursion(discount):
    """Beyond the table: S(c + 1, t) = S(c, t - 1) + (c - discount t) S(c, t), within the error named in `seating.py`."""
    c = np.repeat([300, 5_000, 1_000_000], 5)
    t = np.array([3, 12, 40, 120, 250] * 3)
    value = seating.log_stirling(c + 1, t, discount)
    summed = np.logaddexp(seating.log_stirling(c, t - 1, discount), np.log(c - discount * t) + seating.log_stirling(c, t, discount))
    assert value == pytest.approx(summed, abs=0.02)
    exact = seating.stirling_table(discount)[256]
    t = np.array([1, 30, 100, 150])
    few = t < 256**discount
    got = np.where(few, seating._series(np.full(4, 256.0), t.astype(float), discount), seating._saddle(np.full(4, 256.0), t.astype(float), discount))
    assert got[few] == pytest.approx(exact[t[few]], abs=1e-6) and got[1:] == pytest.approx(exact[t[1:]], abs=0.04)


def enumerated(counts, parent, strength, discount):
    """Mean tables of each dish of one restaurant, over all seatings."""
    exact = stirling(max(counts), discount)
    total, sums = 0.0, np.zeros(len(counts))
    for choice in np.ndindex(*counts):
        t = np.array(choice) + 1
        weight = math.prod(strength + discount * i for i in range(int(t.sum())))
        weight *= math.prod(parent[k] ** int(t[k]) * exact[counts[k]][int(t[k])] for k in range(len(counts)))
        total += weight
        sums += weight * t
    return sums / total


def test_sweeps_have_the_exact_distribution():
    counts, parent = [5, 2, 3, 1], np.array([0.5, 0.2, 0.25, 0.05])
    house = seating.Restaurants(np.zeros(4, np.int64), np.array(counts), seating.first_tables(np.array(counts)), 1)
    rng, total, n = np.random.default_rng(1), np.zeros(4), 6000
    for i in range(n + 100):
        house.sweep(np.log(parent), 1.5, 0.6, rng)
        total += house.tables if i >= 100 else 0
    assert total / n == pytest.approx(enumerated(counts, parent, 1.5, 0.6), abs=0.05)


def test_large_dishes_reach_the_distribution_of_small_ones(monkeypatch):
    """The Metropolis steps of large dishes draw what the table draws for small ones."""
    counts = np.array([200, 200])
    means = []
    for limit in (256, 100):
        monkeypatch.setattr(seating, "LIMIT", limit)
        seating.stirling_table.cache_clear()
        house, rng, total = seating.Restaurants(np.zeros(2, np.int64), counts, np.array([5, 5]), 1), np.random.default_rng(2), np.zeros(2)
        for i in range(6000):
            house.sweep(np.log([0.3, 0.02]), 5.0, 0.5, rng)
            total += house.tables if i >= 1000 else 0
        means.append(total / 5000)
    seating.stirling_table.cache_clear()
    assert means[0] == pytest.approx(means[1], rel=0.05)


def trained(spark, texts, most=250_000, buckets=3, **kw):
    """The model's buckets, kept rounds and levels, for documents that are all learnt."""
    ids = [i for i in range(10_000) if not hpylm.held_out(i)][: len(texts)]
    row = dict(zip([f.split()[0] for f in hpylm.SHARDS.split(", ")], hpylm.shard_row(ids, texts, 0), strict=True))
    counts = row["counts"]
    known = np.flatnonzero(counts)
    order = known[np.argsort(-counts[known], kind="stable")]
    sizes = hpylm.Sizes(int(counts.sum()), len(order), row["n_learnt"], buckets, most)
    rows = [r for r in hpylm.shard_pairs(row, order, np.arange(len(order)), counts[order], sizes) if r[0] == "req"]
    packs = [hpylm.merge_bucket(hpylm._rows(hpylm.PAIRS, [r]), sizes) for r in rows]
    models = spark.createDataFrame([p.to_pylist()[0] for p in packs], hpylm.PACKS)
    kept, levels, parts = hpylm.train(models, sizes, **kw)
    return sizes, packs, kept, levels.toPandas(), parts


@pytest.mark.parametrize("most", [250_000, 3])
def test_predictive_sums_to_one(spark, most):
    """Over all words and one for the unknown, in every context, also in contexts that several buckets hold."""
    rng = random.Random(3)
    sizes, packs, kept, levels, parts = trained(spark, [" ".join(rng.choices("abcdefg", k=30)) for _ in range(8)], most)
    level, state = kept[-1]
    own = levels[levels.level == level]
    context_sum, root = {}, {}
    for pack in packs:
        bucket = hpylm.Bucket(pack.to_pylist()[0], sizes)
        mine = own[own.bucket == pack.column("bucket")[0].as_py()]
        words = mine[mine.kind == "word"]
        counts, shared = bucket.take(list(zip(words.part, words.a, words.b, strict=True)), parts)
        seats = mine[(mine.kind == "seats") & (mine.part == hpylm.SWEEPS - 1)].a.iloc[0]
        parent = bucket.parent(counts, state)
        p = bucket.predictive(bucket.tables(seats), shared, parent, state)
        root |= dict(zip(bucket.words.tolist(), parent.tolist(), strict=True))
        opened = np.where(bucket.split, shared, np.bincount(bucket.context[bucket.learnt], bucket.tables(seats), len(bucket.contexts)))
        back = (state.strength + state.discount * opened) / (state.strength + bucket.whole)
        for c, w, x in zip(bucket.context, bucket.word, p, strict=True):
            context_sum.setdefault(int(bucket.contexts[c]), []).append((int(bucket.words[w]), float(x), float(back[c])))
    base = (state.root_strength + state.root_discount * state.tables) / (sizes.words + 1) / (state.root_strength + state.customers)
    assert sum(root.values()) + base == pytest.approx(1.0)
    for seen in context_sum.values():
        unseen = 1.0 - sum(root[w] for w, _, _ in seen)
        assert sum(x for _, x, _ in seen) + seen[0][2] * unseen == pytest.approx(1.0)


def test_predictive_follows_plain_gibbs(spark):
    """Mean predictive probabilities against a plain sampler that seats customers one by one, at the parameters drawn last."""
    rng = random.Random(8)
    after = {w: rng.choices("abcd", k=2) for w in "abcd"}
    texts = []
    for _ in range(30):
        w, out = "a", []
        for _ in range(8):
            out.append(w)
            w = rng.choice(after[w])
        texts.append(" ".join(out))
    sizes, packs, kept, levels, parts = trained(spark, texts, buckets=1, rounds=25, burn_in=5)
    bucket = hpylm.Bucket(packs[0].to_pylist()[0], sizes)
    total, n = np.zeros(len(bucket.counts)), 0
    for level, state in kept:
        own = levels[levels.level == level]
        words = own[own.kind == "word"]
        root, shared = bucket.take(list(zip(words.part, words.a, words.b, strict=True)), parts)
        for seats in own[own.kind == "seats"].a:
            total += bucket.predictive(bucket.tables(seats), shared, bucket.parent(root, state), state)
            n += 1
    state = kept[-1][1]
    want = plain_gibbs(bucket, sizes, state, np.random.default_rng(5))
    assert total / n == pytest.approx(want, abs=0.04)


def plain_gibbs(bucket, sizes, state, rng, sweeps=60):
    """One customer at a time: leaves its table (and the root, if that table closes) and is seated again."""
    d, s, d0, s0 = state.discount, state.strength, state.root_discount, state.root_strength
    seats = {k: [] for k in zip(bucket.context.tolist(), bucket.word.tolist(), strict=True)}
    root = {w: [] for w in range(len(bucket.words))}

    def weigh(tables, discount, fresh):
        return [n - discount for n in tables] + [fresh]

    def root_probability(w):
        everyone, tables = sum(map(sum, root.values())), sum(map(len, root.values()))
        base = 1 / (sizes.words + 1)
        return (sum(root[w]) - d0 * len(root[w]) + (s0 + d0 * tables) * base) / (s0 + everyone)

    def choose(weights):
        return int(rng.choice(len(weights), p=np.array(weights) / sum(weights)))

    def enter_root(w):
        at = choose(weigh(root[w], d0, (s0 + d0 * sum(map(len, root.values()))) / (sizes.words + 1)))
        root[w][at:] = [root[w][at] + 1, *root[w][at + 1 :]] if at < len(root[w]) else [1]

    def leave(tables):
        at = choose(tables)
        tables[at] -= 1
        if not tables[at]:
            del tables[at]
            return True
        return False

    def enter(c, w):
        open_tables = sum(len(t) for (x, _), t in seats.items() if x == c)
        at = choose(weigh(seats[c, w], d, (s + d * open_tables) * root_probability(w)))
        if at == len(seats[c, w]):
            seats[c, w].append(1)
            enter_root(w)
        else:
            seats[c, w][at] += 1

    customers = [(c, w) for c, w, n in zip(bucket.context.tolist(), bucket.word.tolist(), bucket.counts.tolist(), strict=True) for _ in range(n)]
    for c, w in customers:
        enter(c, w)
    total = np.zeros(len(bucket.counts))
    for i in range(sweeps):
        for c, w in customers:
            if leave(seats[c, w]):
                leave(root[w])
            enter(c, w)
        if i >= 10:
            for k, (c, w) in enumerate(seats):
                open_tables = sum(len(t) for (x, _), t in seats.items() if x == c)
                total[k] += (sum(seats[c, w]) - d * len(seats[c, w]) + (s + d * open_tables) * root_probability(w)) / (s + bucket.whole[c])
    return total / (sweeps - 10)
