import zlib

import numpy as np

from evenkeel.llm.language_id import UNDETERMINED, detect_languages, em, mixtures, trigram_counts
from evenkeel.llm.queries import op3_language_id, read


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in read(spark, sf, "documents").collect()}
    got = op3_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95


def test_trigrams_by_hand():
    doc, bucket, n, has = trigram_counts(["ab", "", "12 ab-AB", "!!"])
    assert has.tolist() == [True, False, True, False]
    one = dict(zip(bucket[doc == 0].tolist(), n[doc == 0].tolist(), strict=True))
    assert sum(one.values()) == 2  # " ab" and "ab "
    two = dict(zip(bucket[doc == 2].tolist(), n[doc == 2].tolist(), strict=True))
    assert {k: v for k, v in two.items() if k in one} == {k: 2 * v for k, v in one.items()}


def test_mixture_of_two_languages():
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(1 << 16) * 0.01, 3).T + 1e-9).astype(np.float32)
    p = np.exp(logp.astype(float))
    p /= p.sum(0)
    mixed = np.bincount(rng.choice(1 << 16, 900, p=0.7 * p[:, 0] + 0.3 * p[:, 2]), minlength=1 << 16)
    pure = np.bincount(rng.choice(1 << 16, 900, p=p[:, 1]), minlength=1 << 16)
    doc = np.repeat([0, 1], [np.count_nonzero(mixed), np.count_nonzero(pure)])
    bucket = np.concatenate([np.flatnonzero(mixed), np.flatnonzero(pure)])
    n = np.concatenate([mixed[mixed > 0], pure[pure > 0]])
    docs, theta = mixtures(logp, doc, bucket, n, 20, 2.0)
    assert docs.tolist() == [0, 1]
    assert abs(theta[0, 0] - 0.7) < 0.06 and theta[0, 1] == 0 and abs(theta[0, 2] - 0.3) < 0.06
    assert theta[1].tolist() == [0, 1, 0]


def test_em_does_not_lower_the_likelihood():
    rng = np.random.default_rng(1)
    p, n = rng.random((40, 3)), rng.integers(1, 9, 40).astype(float)
    starts, doc = np.array([0, 15]), np.repeat([0, 1], [15, 25])
    ll = [em(p, n, starts, doc, np.full((2, 3), 1 / 3), k)[1] for k in range(6)]
    assert all((b >= a - 1e-9).all() for a, b in zip(ll, ll[1:], strict=False))


def test_edges(spark, odd, none):
    got = {r.doc_id: r for r in detect_languages(odd).collect()}
    assert len(got) and got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == got[13].lang_pred == UNDETERMINED
    assert got[1].lang_pred == "en" and got[4].score == 0
    assert detect_languages(none).collect() == []
    blind = detect_languages(odd.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in blind} == {UNDETERMINED} and len(blind) == odd.count()


def test_chosen_set_against_every_subset():
    """The nested sets hold the best set of all subsets by penalised likelihood, and its proportions are those of its own EM."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    k, buckets = 4, 300
    logp = np.log(rng.dirichlet(np.ones(buckets) * 0.08, k).T + 1e-9).astype(np.float32)
    p = np.exp(logp.astype(float))
    p /= p.sum(0)
    agree = 0
    for trial in range(40):
        own = rng.choice(k, int(rng.integers(1, 4)), replace=False)
        share = rng.dirichlet(np.ones(len(own)) * 4)
        counts = np.bincount(rng.choice(buckets, int(rng.integers(60, 600)), p=p[:, own] @ share / (p[:, own] @ share).sum()), minlength=buckets)
        bucket = np.flatnonzero(counts)
        n = counts[bucket].astype(float)
        _, theta = mixtures(logp, np.zeros(len(bucket), np.int64), bucket, counts[bucket], 200, 2.0)
        cost = {}
        for size in range(1, k + 1):
            for s in combinations(range(k), size):
                lp = logp[bucket].astype(float)
                q = np.exp(lp - lp.max(1, keepdims=True))[:, s]
                t, ll = em(np.maximum(q, 1e-30), n, np.array([0]), np.zeros(len(n), np.int64), np.full((1, size), 1 / size), 400)
                cost[s] = (-ll[0] + (size - 1) * 2.0 * np.log(n.sum()), t[0])
        best = min(cost, key=lambda s: cost[s][0])
        chosen = tuple(np.flatnonzero(theta[0]).tolist())
        agree += chosen == best
        assert cost[chosen][0] <= cost[best][0] + 3.0  # a nested set may miss the best by a little
        assert np.allclose(theta[0][list(chosen)], cost[chosen][1], atol=0.02)
    assert agree >= 36


def test_fit_counts_plainly(spark):
    from evenkeel.llm.language_id import BITS, fit

    rows = [(i, f"{'abc' if i % 2 else 'xyz'} word{i % 5} é", "en" if i % 2 else "de", "") for i in range(60)]
    langs, logp = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, n string").repartition(4), "doc_id", "text", "lang", 10_000)
    want = np.full((1 << BITS, 2), 0.5)
    for i, t, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            _, bucket, n, _ = trigram_counts([t])
            want[bucket, ["de", "en"].index(lang)] += n
    assert langs == ["de", "en"] and np.allclose(logp, np.log(want / want.sum(0)), atol=1e-5)


def test_very_long_text(spark):
    rows = [(i, ("the quick brown fox " if i % 2 else "der schnelle braune fuchs ") * 20, "en" if i % 2 else "de") for i in range(40)]
    rows += [(1001, "the quick brown fox jumps " * 800_000, None)]
    got = {r.doc_id: r for r in detect_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(rows[-1][1]) > 20_000_000 and got[1001].lang_pred == "en" and got[1001].score > 0.9
